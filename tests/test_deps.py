import random

import pytest
from pyspark.sql import functions as F

from depuse.operators import deps as D
from depuse.operators import graph as G
from tests.conftest import rows
from tests.test_graph import adjacency, random_edges
from tests.test_properties import bfs_hops

SESSION = "clientId int, sessionId bigint, startTime bigint, endTime bigint, gavs array<string>"
GAVS = [["v1"], ["v1", "v2", "v3"], [f"v{k}" for k in range(16)], ["stranger"], ["v4", "stranger", "v9"], ["alone", "v0"]]


def sessions(spark, lists):
    data = [(7, i, 100 + i, 200 + i, gavs) for i, gavs in enumerate(lists)]
    return spark.createDataFrame(data, SESSION)


def expected(edges, gavs, most=None):
    hops = {(a[1:], b[1:]): k for (a, b), k in bfs_hops(edges).items() if most is None or k <= most}
    return sorted({b for a in gavs for b in gavs if (a, b) in hops})


@pytest.mark.parametrize("depth", [0, 1, 2, 3, 40])
def test_sessions_agree_with_brute_force(spark, tmp_dir, depth):
    _, edges = adjacency(spark, tmp_dir)
    got = {r["sessionId"]: r for r in D.compute_dependencies(sessions(spark, GAVS), edges, depth=depth).collect()}
    for i, gavs in enumerate(GAVS):
        assert got[i]["dependencies"] == expected(random_edges(11), gavs, depth if depth > 1 else None)
        assert got[i]["execMillis"] == -1 and got[i]["errorDeps"] is None


def test_default_depth_is_the_whole_closure(spark):
    chain = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(45)], "src string, dst string")
    got = D.compute_dependencies(sessions(spark, [["n0", "n43"]]), chain).first()
    assert got["dependencies"] == ["n43"]
    closure = G.transitive_closure(chain)
    assert D.compute_dependencies(sessions(spark, [["n0", "n43"]]), closure=closure).first()["dependencies"] == ["n43"]


def test_hop_limit(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    sess = sessions(spark, [["a", "c"], ["a", "d"], ["b", "a"]])
    two = {r["sessionId"]: r["dependencies"] for r in D.compute_dependencies(sess, edges, depth=2).collect()}
    assert two == {0: ["c"], 1: [], 2: ["b"]}
    assert rows(D.session_dependencies(sess, G.reachable(edges, max_depth=1)), "sessionId", "dependency") == [(2, "b")]


def test_cycle_member_is_its_own_dependency(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    enhanced = D.compute_dependencies(sessions(spark, [["a"]]), edges, depth=0)
    assert enhanced.collect()[0]["dependencies"] == ["a"]


def test_negative_depth_rejected(spark, tmp_dir):
    _, edges = adjacency(spark, tmp_dir)
    with pytest.raises(ValueError):
        D.compute_dependencies(sessions(spark, [["v1"]]), edges, depth=-1)


def test_salted_and_split_targets_change_nothing(spark, tmp_dir, monkeypatch):
    _, edges = adjacency(spark, tmp_dir)
    draw = random.Random(5)
    many = sessions(spark, [GAVS[2]] * 30 + [draw.sample(GAVS[2], 5) for _ in range(20)])
    reach = G.transitive_closure(edges)
    plain = rows(D.session_dependencies(many, reach, salt=False))
    assert rows(D.session_dependencies(many, reach, salt=True)) == plain
    monkeypatch.setattr(D, "TARGETS_PER_ROW", 2)
    assert rows(D.session_dependencies(many, reach)) == plain


def test_only_hits_leave_the_join(spark, tmp_dir):
    """Targets outside the session are dropped in the stage that joins."""
    _, edges = adjacency(spark, tmp_dir)
    plan = D.session_dependencies(sessions(spark, GAVS), edges, salt=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in plan


def _random_sessions(seed, n=12, most=14, nodes=16):
    draw = random.Random(seed)
    return [(k % 3, k, [f"v{x}" for x in draw.sample(range(nodes), draw.randrange(most + 1))]) for k in range(n)]


SHORT = "clientId int, sessionId long, gavs array<string>"


@pytest.mark.parametrize("packed_from", [0, 3, 64])
def test_packed_sessions_equal_plain_ones(spark, packed_from):
    draw = random.Random(4)
    reach = sorted({(f"v{draw.randrange(16)}", f"v{draw.randrange(16)}") for _ in range(60)})
    sessions = _random_sessions(8) + [(9, 1, ["v1", "v1", "v2"]), (9, 2, None)]
    want = sorted({(c, s, b) for c, s, g in sessions for a, b in reach if g and a in g and b in g})
    frame, pairs = spark.createDataFrame(sessions, SHORT), spark.createDataFrame(reach, "src string, dst string")
    for salt in (True, False):
        assert rows(D.session_dependencies(frame, pairs, salt, packed_from)) == want


def test_session_of_ten_thousand_gavs(spark):
    """More than one block of numbers; what the join yields is linear."""
    n = 40_000
    sessions = spark.range(n).groupBy(F.lit(1).cast("int").alias("clientId"), F.lit(5).cast("long").alias("sessionId")).agg(
        F.collect_list(F.concat(F.lit("g"), F.col("id").cast("string"))).alias("gavs")
    )
    reach = spark.range(0, 3 * n, 3).select(
        F.concat(F.lit("g"), F.col("id").cast("string")).alias("src"),
        F.explode(F.array(*[F.concat(F.lit("g"), (F.col("id") + k).cast("string")) for k in (1, 20_001)])).alias("dst"),
    )
    got = D.session_dependencies(sessions, reach)
    starts = range(0, n, 3)
    want = {k + 1 for k in starts if k + 1 < n} | {k + 20_001 for k in starts if k + 20_001 < n}
    assert {int(r.dependency[1:]) for r in got.collect()} == want


@pytest.mark.parametrize("seed,bound,packed_from", [(1, 3, 64), (2, 4, 0), (3, None, 4), (5, None, 64)])
def test_session_work_matches_brute_force(spark, seed, bound, packed_from):
    draw = random.Random(seed)
    known = sorted({(f"v{draw.randrange(9)}", f"v{draw.randrange(9)}") for _ in range(14)})
    if bound is None:
        known = [(a, b) for a, b in known if a < b]  # no cycle
    out = {}
    for a, b in known:
        out.setdefault(a, []).append(b)

    def trails(node, used):
        for b in out.get(node, []):
            if (node, b) not in used and (bound is None or len(used) < bound):
                yield b, len(used) + 1
                yield from trails(b, used | {(node, b)})

    sessions = _random_sessions(seed, 10, 6, 10) + [(8, 1, ["v1", "v1", "absent"]), (8, 2, [])]
    want = []
    for c, s, gavs in sessions:
        found = [length for a in set(gavs) for end, length in trails(a, frozenset()) if end in gavs]
        want.append((c, s, len(found), sum(found)))
    got = D.session_traversal_work(
        spark.createDataFrame(sessions, SHORT), spark.createDataFrame(known, "src string, dst string"), bound, packed_from=packed_from
    )
    assert rows(got) == sorted(want)


def test_session_work_ignores_cycles_that_lead_to_no_member(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("a", "d")], "src string, dst string")
    sessions = spark.createDataFrame([(1, 1, ["a", "d"]), (1, 2, ["c"])], SHORT)
    with pytest.raises(ValueError, match="cycle"):
        D.session_traversal_work(sessions, edges)
    assert rows(D.session_traversal_work(sessions.filter("sessionId = 1"), edges)) == [(1, 1, 1, 1)]


@pytest.mark.parametrize("packed_from", [1, 64])
def test_targets_of_absent_sources_are_not_met(spark, monkeypatch, packed_from):
    """Rows of the closure that go into a join beyond its first filter."""
    chain = [(f"n{a:02}", f"n{b:02}") for a in range(40) for b in range(a + 1, 40)]
    closure = spark.createDataFrame(chain, "src string, dst string")
    known = spark.createDataFrame([(1, 0, 0, 0, ["n05", "n30", "else"]), (2, 0, 0, 0, ["n39"])],
                                  "clientId int, sessionId long, startTime long, endTime long, gavs array<string>")
    seen = []
    for name in ("_small_dependencies", "_packed_dependencies"):
        def watched(sessions, reach, salt, inner=getattr(D, name)):
            seen.append(reach.count())
            return inner(sessions, reach, salt)

        monkeypatch.setattr(D, name, watched)
    assert rows(D.session_dependencies(known, closure, packed_from=packed_from)) == [(1, 0, "n30")]
    assert seen and set(seen) == {34 + 9}
    monkeypatch.setattr(D, "FEW_NAMES", 3)
    assert rows(D.session_dependencies(known, closure, packed_from=packed_from)) == [(1, 0, "n30")]
    assert max(seen) == len(chain)


def test_hashes_that_agree_by_chance_make_no_dependency(spark, monkeypatch):
    """Every gav has the same hash; names decide."""
    monkeypatch.setattr(D, "_code", lambda gav: F.lit(7).cast("smallint"))
    draw = random.Random(9)
    reach = sorted({(f"v{draw.randrange(16)}", f"v{draw.randrange(16)}") for _ in range(60)})
    sessions = _random_sessions(10) + [(None, 3, ["v1", "v2", "v5", "v7"]), (9, 1, ["v1", None, "v2"])]
    want = {(c, s, b) for c, s, g in sessions for a, b in reach if a in g and b in g}
    frame, pairs = spark.createDataFrame(sessions, SHORT), spark.createDataFrame(reach, "src string, dst string")
    for salt in (True, False):
        got = rows(D.session_dependencies(frame, pairs, salt))
        assert len(got) == len(want) and set(got) == want


def test_gavs_of_the_sessions_are_counted_once(spark, monkeypatch):
    """Seeds, few names and hot gavs come from one table."""
    made, inner = [], D.present_gavs
    monkeypatch.setattr(D, "present_gavs", lambda sessions: made.append(1) or inner(sessions))
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    got = D.compute_dependencies(sessions(spark, [["a", "c"], ["c"], []]), edges)
    assert {r["sessionId"]: r["dependencies"] for r in got.collect()} == {0: ["c"], 1: [], 2: []} and made == [1]
