import random

import pytest
from pyspark.sql import functions as F

from depuse.operators import graph as G
from depuse.operators import placed
from depuse.operators.placed import PlacedTable
from tests.conftest import rows


def bfs(known):
    out = {}
    for a, b in known:
        out.setdefault(a, set()).add(b)
    least = {}
    for start in out:
        level, depth = set(out[start]), 1
        while level:
            for v in level:
                least[start, v] = depth
            level = {w for v in level for w in out.get(v, ()) if (start, w) not in least}
            depth += 1
    return least


@pytest.fixture(params=[True, False], ids=["placed", "plain"])
def where(request, monkeypatch):
    monkeypatch.setattr(placed, "SMALL_ROWS", 5 if request.param else 1_000_000)
    return request.param


def test_levels_and_measures(spark, where):
    table = PlacedTable(spark, ["a"])
    assert table.append(spark.range(3).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b")), F.max("b")) == (3, 4)
    assert not table.placed
    assert table.append(spark.range(3, 9).select(F.col("id").alias("a"), F.lit(7).cast("long").alias("b")), F.max("b")) == (6, 7)
    assert table.placed == where
    assert table.append(spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b")), F.max("b")) == (0, None)
    assert [r[0] for r in rows(table.level(1))] == [3, 4, 5, 6, 7, 8] and table.level(2).count() == 0
    assert [r[0] for r in rows(table.all())] == list(range(9))
    kept = table.close()
    assert kept.columns == ["a", "b"] and [r[0] for r in rows(kept)] == list(range(9))
    assert table.name not in {t.name for t in spark.catalog.listTables()}


def random_graph(seed):
    draw = random.Random(seed)
    edges = {(f"v{draw.randrange(14)}", f"v{draw.randrange(14)}") for _ in range(20)}
    edges |= {(f"c{k}", f"c{k + 1}") for k in range(13)} | {("c13", "v0"), ("v1", "v1")}
    return sorted(edges)


@pytest.mark.parametrize("bound", [None, 1, 2, 3, 5, 8])
def test_doubling_gives_least_hops(spark, where, bound):
    known = random_graph(3)
    edges = spark.createDataFrame(known, "src string, dst string")
    want = sorted((a, b, k) for (a, b), k in bfs(known).items() if bound is None or k <= bound)
    assert rows(G.reachable(edges, max_depth=bound)) == want
    half = spark.createDataFrame([("c0",), ("v1",), ("nowhere",)], "id string")
    for share in (0.0, 1.1):  # the seeds by doubling, then hop by hop
        G.SEED_SHARE, before = share, G.SEED_SHARE
        try:
            assert rows(G.reachable(edges, half, bound)) == [w for w in want if w[0] in ("c0", "v1")]
        finally:
            G.SEED_SHARE = before
    if bound is None:
        assert rows(G.transitive_closure(edges, salt=True)) == [w[:2] for w in want]


def test_doubling_never_joins_the_closure_with_itself(spark, monkeypatch):
    """The pairs a round starts from are those at exactly its distance."""
    monkeypatch.setattr(placed, "SMALL_ROWS", 10_000)
    starts = []
    append = PlacedTable.append

    def watched(self, added, *measures):
        if "hops" in added.columns and self.key == ["src", "dst"]:
            starts.append(added.count())
        return append(self, added, *measures)

    monkeypatch.setattr(PlacedTable, "append", watched)
    chain = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(40)], "src string, dst string")
    assert G.transitive_closure(chain).count() == 40 * 41 // 2
    # distances 1, 2, 3-4, 5-8, 9-16, 17-32, 33-40
    assert starts == [40, 39, 38 + 37, sum(range(33, 37)), sum(range(25, 33)), sum(range(9, 25)), sum(range(1, 9))]


def test_lookup_in_place_shuffles_only_what_is_new(spark):
    """The table's side of the look-up has no exchange in the plan."""
    table = PlacedTable(spark, ["src", "dst"], small=0)
    table.append(spark.range(2000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    fresh = spark.range(1990, 2010).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).distinct()
    left = fresh.join(table.all().hint("merge"), ["src", "dst"], "left_anti")
    assert left.count() == 10
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1
    again = PlacedTable(spark, ["src", "dst"], small=0)
    again.append(left)  # already lies in its buckets: written without a shuffle
    assert [r[0] for r in rows(again.close())] == list(range(2000, 2010))
    table.close()


def test_many_small_levels_are_read_once_each(spark):
    table = PlacedTable(spark, ["k"])
    want = []
    for number in range(20):
        table.append(spark.createDataFrame([(number, number % 3), (number, 7)], "k int, v int"))
        want += [(number, number % 3), (number, 7)]
        assert rows(table.all()) == sorted(want)
        assert rows(table.level(number)) == sorted(want[-2:])
    assert rows(table.level(3)) == [(3, 0), (3, 7)]
    assert rows(table.close()) == sorted(want)
