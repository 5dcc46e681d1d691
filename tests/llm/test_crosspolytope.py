import numpy as np
import pytest
from pyspark.sql import functions as F

from depuse.llm import crosspolytope

SCHEMA = "vec_id long, embedding array<float>, rank int, bucket int, _salt int"


def brute(rows, top, every):
    """query -> [(score, id)], best first."""
    best = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = [float(np.float32(x)) for x in v]
            best[i] = min(best.get(i, v), v)
    out = {}
    for q in best:
        if q % every == 0:
            mine = [(float(np.dot(best[q], v)), i) for i, v in best.items() if i != q and len(v) == len(best[q])]
            out[q] = sorted(mine, key=lambda m: (-m[0], m[1]))[:top]
    return out


def clustered(seed, n, dim, centres, noise, lengths=(1.0,)):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(centres, dim))
    x = middle[draw.integers(0, centres, n)] + noise * draw.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(k, [float(c) for c in v * draw.choice(lengths)]) for k, v in enumerate(x)]


def run(spark, rows, every, **how):
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], SCHEMA).repartition(3)
    got = crosspolytope.search(df, F.col("vec_id") % every == 0, **how)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    found = {}
    for r in sorted(got.collect()):
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(found[r.query_id])
    return found


def recall(found, want, top):
    """Share of the true neighbours found, equal scores counting as equal."""
    hit = all_ = 0
    for q, near in want.items():
        mine = found.get(q, [])
        assert len({i for _, i in mine}) == len(mine) == len(near) and q not in {i for _, i in mine}
        assert [i for _, i in mine] == [i for _, i in sorted(mine, key=lambda m: (-m[0], m[1]))]
        all_ += len(near)
        hit += sum(s >= near[-1][0] - 1e-9 for s, _ in mine)
    return hit / max(1, all_)


@pytest.mark.parametrize(
    "data, how",
    [
        ((1, 900, 24, 30, 0.1), {}),
        ((2, 900, 24, 30, 0.1), {"block_rows": 60, "query_rows": 7}),  # blocks of buckets and of queries
        ((3, 700, 12, 25, 0.2, (0.05, 1.0, 3.0, 40.0)), {}),  # shells of norms
        ((4, 900, 8, 60, 0.05), {"bucket_rows": 2, "probes": (2, 8, 40)}),  # two concatenated axes
        ((5, 500, 40, 500, 1.0), {}),  # no structure: all is compared
    ],
)
def test_recall(spark, data, how):
    rows = clustered(*data)
    want = brute(rows, 10, 9)
    found = run(spark, rows, 9, top=10, **how)
    exact = dict(rows)
    for q, near in found.items():
        for score, i in near:
            assert score == pytest.approx(float(np.dot(np.float32(exact[q]).astype(float), np.float32(exact[i]).astype(float))), rel=1e-9, abs=1e-12)
    assert recall(found, want, 10) >= 0.95


def test_copies_ties_and_rows_that_take_no_part(spark):
    rows = clustered(6, 200, 8, 10, 0.2)
    rows += [(k, rows[10][1]) for k in range(200, 400)]  # one very common vector
    rows += [(400, None), (401, []), (402, [1.0, None]), (403, [float("nan")] * 8), (404, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(405, [0.0] * 8), (420, [1.0, 2.0]), (425, [-1.0, 0.5]), (430, [3.0]), rows[20], (20, rows[21][1])]
    rows += [(440, [-x for x in rows[0][1]]), (2**62, rows[0][1])]
    want, found = brute(rows, 5, 10), run(spark, rows, 10, top=5)
    assert set(found) == {q for q, near in want.items() if near}
    assert recall(found, {q: n for q, n in want.items() if n}, 5) >= 0.95
    assert [i for _, i in found[300]] == [i for _, i in want[300]] and 10 in {i for _, i in found[300]}
    assert found[420] == [(pytest.approx(0.0), 425)] and 430 not in found


def test_huge_and_tiny_vectors_and_empty_table(spark):
    rows = [(0, [1e30, 1.0]), (10, [2e30, -1.0]), (20, [1e-30, 1e-30]), (30, [-1e30, 0.0])]
    found = run(spark, rows, 10)
    assert [i for _, i in found[0]] == [10, 20, 30]
    assert run(spark, [], 10) == {}


def test_rotation_keeps_lengths_and_angles():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(50, 20))
    y = crosspolytope.turned(x, 1, 0)
    assert y.shape == (50, 32)
    assert np.allclose(x @ x.T, y @ y.T)


def test_chance_is_that_of_the_hash():
    draw = np.random.default_rng(1)
    q = draw.normal(size=(600, 32))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    u = draw.normal(size=q.shape)
    u -= (u * q).sum(1, keepdims=True) * q
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for cosine, probes, axes in ((0.5, 4, 1), (0.8, 4, 1), (0.8, 6, 2)):
        x = cosine * q + np.sqrt(1 - cosine**2) * u
        hit = np.zeros(len(q), bool)
        for table in range(3):
            asked = crosspolytope.probe_codes(q, table, axes, probes)
            hit |= np.array([c in p for c, p in zip(crosspolytope.codes(x, table, axes), asked)])
        assert abs(hit.mean() - crosspolytope.chance(cosine, 32, axes, 3, probes)) < 0.08


def test_probes_begin_with_the_own_bucket_and_cover_all():
    x = np.random.default_rng(2).normal(size=(20, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for axes in (1, 2):
        probes = crosspolytope.probe_codes(x, 0, axes, 8**axes)
        assert [p[0] for p in probes] == list(crosspolytope.codes(x, 0, axes))
        assert all(sorted(p) == list(range(8**axes)) for p in probes)
