import random

import pytest
from pyspark.sql import functions as F

from depuse.operators import graph as G
from depuse.sources.text import (
    DIRECT_EDGE_TYPE,
    TRANSITIVE_EDGE_TYPE,
    parse_dependency_records,
    read_adjacency,
    read_graph,
)
from tests.conftest import rows
from tests.test_properties import bfs_hops

P = "t:"  # short gav prefix


def records(spark, spec):
    data = [(f"1 path{i} {P}{g} {','.join(d if d in ('NO_DEPS', 'UNKNOWN_DEPS') else P + d for d in deps)}",)
            for i, (g, deps) in enumerate(spec)]
    return parse_dependency_records(spark.createDataFrame(data, "value string"))


# A web application and what it builds on; two leaves say that they have none.
WEB = [
    ("web", ["json", "http"]),
    ("http", ["sockets"]),
    ("json", ["NO_DEPS"]),
    ("mail", ["UNKNOWN_DEPS"]),
    ("cron", ["http", "clock", "NO_DEPS"]),
]


def ids(df, col="id"):
    return sorted(r[col].replace(P, "") for r in df.collect())


def test_sentinel_only_records_are_no_nodes_unless_named(spark):
    nodes, edges = G.build_graph(records(spark, WEB))
    assert ids(nodes) == ["clock", "cron", "http", "json", "sockets", "web"]
    assert edges.count() == 5


def test_repeated_gav_unions_dependencies(spark):
    nodes, edges = G.build_graph(records(spark, WEB + [("mail", ["sockets"]), ("web", ["http", "mail"])]))
    assert "mail" in ids(nodes)
    assert edges.count() == 7


def test_chain_longer_than_forty_reaches_its_end(spark):
    chain = [(f"n{k}", f"n{k + 1}") for k in range(50)]
    edges = spark.createDataFrame(chain, "src string, dst string")
    closure = G.transitive_closure(edges)
    assert closure.count() == 50 * 51 // 2
    assert rows(closure.filter("src = 'n0' and dst = 'n50'")) == [("n0", "n50")]


def test_diamond_closure_is_exact(spark):
    recs = records(spark, [("A", ["B", "C"]), ("B", ["D"]), ("C", ["D"]), ("D", ["E"])])
    closure = G.transitive_closure(G.direct_edges(recs))
    got = {(r["src"].replace(P, ""), r["dst"].replace(P, "")) for r in closure.collect()}
    assert {("C", "D"), ("C", "E"), ("B", "E"), ("A", "E")} <= got
    assert len(got) == 4 + 2 + 2 + 1


def test_cycle_reaches_itself(spark):
    recs = records(spark, [("a", ["b"]), ("b", ["a", "c"])])
    got = rows(G.reachable(G.direct_edges(recs)).select(
        F.regexp_replace("src", P, "").alias("s"), F.regexp_replace("dst", P, "").alias("d"), "hops"))
    assert got == [("a", "a", 2), ("a", "b", 1), ("a", "c", 2), ("b", "a", 1), ("b", "b", 2), ("b", "c", 1)]


def test_sentinels_only_is_isolated_node(spark):
    recs = records(spark, [("x", ["NO_DEPS", "UNKNOWN_DEPS"])])
    nodes, edges = G.build_graph(recs)
    assert ids(nodes) == ["x"]
    assert edges.count() == 0


def test_mixed_sentinels_are_stripped(spark):
    kept = G.retained_records(records(spark, [("m", ["a", "NO_DEPS"]), ("n", ["NO_DEPS"])]))
    assert [(r["gav"], r["dependencies"]) for r in kept.collect()] == [(P + "m", [P + "a"])]


def random_edges(seed, nodes=16, n=30):
    draw = random.Random(seed)
    return sorted({(f"v{draw.randrange(nodes)}", f"v{draw.randrange(nodes)}") for _ in range(n)})


def adjacency(spark, tmp_dir, seed=11):
    """A random graph (cycles included) written and read as adjacency lines."""
    out = {}
    for a, b in random_edges(seed):
        out.setdefault(a, []).append(b)
    path = f"{tmp_dir}/adj.txt"
    with open(path, "w") as fh:
        fh.write("".join(f"{a} {','.join(bs)}\n" for a, bs in out.items()) + "alone\n")
    return read_adjacency(spark, path)


def test_adjacency_graph_counts(spark, tmp_dir):
    nodes, edges = adjacency(spark, tmp_dir)
    stats = G.graph_stats(nodes, edges).collect()[0]
    known = random_edges(11)
    assert (stats["nodes"], stats["edges"]) == (len({v for e in known for v in e}) + 1, len(known))
    least = bfs_hops(known)
    assert {(r.src, r.dst): r.hops for r in G.reachable(edges).collect()} == {(a[1:], b[1:]): k for (a, b), k in least.items()}


def test_closure_idempotent_and_hops_monotone(spark, tmp_dir):
    _, edges = adjacency(spark, tmp_dir)
    closure = G.transitive_closure(edges)
    again = G.transitive_closure(closure)
    assert rows(again) == rows(closure)
    one = set(rows(G.reachable(edges, max_depth=1).select("src", "dst")))
    two = set(rows(G.reachable(edges, max_depth=2).select("src", "dst")))
    assert one == set(rows(edges)) and one <= two <= set(rows(closure))


def test_seeded_reach_matches_full(spark, tmp_dir):
    _, edges = adjacency(spark, tmp_dir)
    seeds = spark.createDataFrame([("v1",), ("v5",)], "id string")
    seeded = rows(G.reachable(edges, seeds=seeds))
    full = [r for r in rows(G.reachable(edges)) if r[0] in ("v1", "v5")]
    assert seeded == full


def test_validate_edges(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "z"), ("z", "b")], "src string, dst string")
    assert rows(G.validate_edges(edges, nodes)) == [("a", "b")]


def test_graph_files_round_trip(spark, tmp_dir):
    nodes, edges = G.build_graph(records(spark, WEB + [("ftp", ["sockets"])]))
    G.write_graph(nodes, edges, f"{tmp_dir}/nodes", f"{tmp_dir}/edges")
    header = open(sorted(__import__("glob").glob(f"{tmp_dir}/nodes/part-*.csv"))[0]).readline().strip()
    assert header == "id:ID|:LABEL"
    n2, e2 = read_graph(spark, f"{tmp_dir}/nodes", f"{tmp_dir}/edges")
    assert rows(n2) == rows(nodes)
    assert rows(e2) == rows(edges)
    with pytest.raises(ValueError, match="T_DEPENDS_ON"):
        read_graph(spark, f"{tmp_dir}/nodes", f"{tmp_dir}/edges", TRANSITIVE_EDGE_TYPE)
    G.write_graph(nodes, edges, f"{tmp_dir}/nodes", f"{tmp_dir}/edges", G.transitive_closure(edges))
    both = [read_graph(spark, f"{tmp_dir}/nodes", f"{tmp_dir}/edges", t)[1] for t in (DIRECT_EDGE_TYPE, TRANSITIVE_EDGE_TYPE)]
    assert [rows(e) for e in both] == [rows(edges), rows(G.transitive_closure(edges))]


def test_empty_graph_refused(spark, tmp_dir):
    nodes, edges = G.build_graph(records(spark, [("q", ["NO_DEPS"])]))
    with pytest.raises(ValueError):
        G.write_graph(nodes, edges, f"{tmp_dir}/n", f"{tmp_dir}/e")


def test_traversal_work_counts_paths(spark):
    # A->B, A->C, B->D, C->D, D->E : paths from A: AB AC ABD ACD ABDE ACDE
    edges = spark.createDataFrame(
        [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "E")], "src string, dst string")
    seeds = spark.createDataFrame([("A",), ("D",), ("E",)], "id string")
    got = rows(G.traversal_work(edges, seeds))
    assert got == [("A", 6, 1 + 1 + 2 + 2 + 3 + 3), ("D", 1, 1)]


def test_traversal_work_on_a_cycle(spark):
    # a->b, b->a, b->c : trails from a: ab, aba, abc ; from b: ba, bc, bab, babc
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("b",)], "id string")
    assert rows(G.traversal_work(edges, seeds, max_depth=9)) == [("a", 3, 1 + 2 + 2), ("b", 4, 1 + 1 + 2 + 3)]
    assert rows(G.traversal_work(edges, seeds, max_depth=2)) == [("a", 3, 5), ("b", 3, 1 + 1 + 2)]
    for bad in ({"mode": "counts"}, {"mode": "counts", "max_depth": 3}, {}, {"mode": "trails"}):
        with pytest.raises(ValueError):
            G.traversal_work(edges, seeds, **bad)
    leaf = spark.createDataFrame([("c",)], "id string")  # reaches no cycle
    assert G.traversal_work(edges, leaf).count() == 0


def test_dense_cycle_with_a_tail_is_recognised(spark):
    dense = [(f"d{a}", f"d{b}") for a in range(8) for b in range(8) if a != b]
    tail = [("d0", "t0")] + [(f"t{k}", f"t{k + 1}") for k in range(12)]
    edges = spark.createDataFrame(dense + tail, "src string, dst string")
    seeds = spark.createDataFrame([("d3",)], "id string")
    with pytest.raises(ValueError, match="cycle"):
        G.traversal_work(edges, seeds)
    tail_only = spark.createDataFrame([("t0",)], "id string")
    assert rows(G.traversal_work(edges, tail_only)) == [("t0", 12, sum(range(1, 13)))]


@pytest.mark.parametrize("seed,bound", [(1, 3), (2, 4), (3, 2), (4, None)])
def test_traversal_work_matches_brute_force(spark, seed, bound):
    known = random_edges(seed, 7, 10)
    if bound is None:
        known = [(a, b) for a, b in known if a < b]  # no cycle
    out = {}
    for a, b in known:
        out.setdefault(a, []).append(b)

    def trails(node, used):
        for b in out.get(node, []):
            if (node, b) not in used and (bound is None or len(used) < bound):
                yield len(used) + 1
                yield from trails(b, used | {(node, b)})

    want = sorted((v, len(t), sum(t)) for v in out if (t := list(trails(v, frozenset()))))
    edges = spark.createDataFrame(known, "src string, dst string")
    seeds = spark.createDataFrame([(v,) for v in out], "id string")
    assert rows(G.traversal_work(edges, seeds, max_depth=bound)) == want


def test_salted_expansion_same_result(spark, tmp_dir):
    _, edges = adjacency(spark, tmp_dir)
    assert rows(G.reachable(edges, salt=True)) == rows(G.reachable(edges))
    assert rows(G.transitive_closure(edges, salt=True)) == rows(G.reachable(edges).select("src", "dst"))


def test_edge_files_are_packed_and_short(spark, tmp_dir, monkeypatch):
    import glob
    import gzip

    monkeypatch.setattr(G, "EDGES_PER_FILE", 500)
    chain = [(f"org.part:p{k:03}", f"org.part:p{k + 1:03}") for k in range(60)]
    edges = spark.createDataFrame(chain, "src string, dst string")
    closure = G.transitive_closure(edges).orderBy("src")
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    G.write_graph(nodes, edges, f"{tmp_dir}/nodes", f"{tmp_dir}/edges", closure)
    files = glob.glob(f"{tmp_dir}/edges/part-*")
    texts = [gzip.open(f, "rt").read().splitlines() for f in files if f.endswith(".gz")]
    assert len(texts) == len(files) and all(t[0] == ":START_ID|:END_ID|:TYPE" and len(t) <= 501 for t in texts)
    assert sum(len(t) - 1 for t in texts) == 60 + 60 * 61 // 2
    assert rows(read_graph(spark, f"{tmp_dir}/nodes", f"{tmp_dir}/edges")[1]) == sorted(chain)
    assert rows(read_graph(spark, f"{tmp_dir}/nodes", f"{tmp_dir}/edges", TRANSITIVE_EDGE_TYPE)[1]) == rows(closure)
