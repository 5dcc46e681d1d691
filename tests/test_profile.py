from collections import Counter

import pytest

from depuse.operators import profile as P
from tests.conftest import rows
from tests.test_deps import expected, sessions
from tests.test_graph import adjacency, random_edges

LISTS = [["v1", "v2"], ["v1", "v9"], ["v3", "v4", "v5"], [f"v{k}" for k in range(16)], ["v7"], ["stranger", "v0"]]


def test_histogram_and_sample(spark):
    sess = sessions(spark, LISTS)
    assert rows(P.session_size_histogram(sess)) == sorted(Counter(len(x) for x in LISTS).items())
    sample = rows(P.sample_by_size(sess, 2, 16, 1, 2), "sessionId", "gavsSize")
    assert sample == [(0, 2), (1, 2), (2, 3), (3, 16)]
    assert rows(P.sample_by_size(sess, 2, 16, 14, 1), "sessionId") == [(0,), (3,)]


def test_sample_arguments(spark):
    sess = sessions(spark, LISTS)
    for bad in ((1, 5, 1, 1), (5, 4, 1, 1), (2, 5, 0, 1), (2, 5, 1, 0)):
        with pytest.raises(ValueError):
            P.sample_by_size(sess, *bad)


def test_depth_sweep_agrees_with_brute_force(spark, tmp_dir):
    _, edges = adjacency(spark, tmp_dir)
    sess = sessions(spark, LISTS)
    got = {(r["depth"], r["sessionId"]): r for r in P.depth_sweep(sess, edges, (0, 1, 2, 3)).collect()}
    assert len(got) == 4 * len(LISTS)
    for (depth, number), r in got.items():
        want = expected(random_edges(11), LISTS[number], depth if depth > 1 else None)
        assert r["dependencies"] == want and r["n_dependencies"] == len(want)
    with pytest.raises(ValueError):
        P.depth_sweep(sess, edges, (-1,))
