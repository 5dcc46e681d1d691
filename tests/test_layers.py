import random

import pytest

from depuse.operators import deps as D
from depuse.operators import graph as G
from depuse.operators import placed
from depuse.operators.placed import PlacedTable
from tests.conftest import rows


@pytest.fixture(autouse=True)
def layered(monkeypatch):
    monkeypatch.setattr(G, "LAYERED_FROM", 0)


def acyclic(seed, nodes=30, edges=70):
    draw = random.Random(seed)
    pairs = {tuple(sorted(draw.sample(range(nodes), 2))) for _ in range(edges)}
    return sorted((f"v{a:02}", f"v{b:02}") for a, b in pairs)


def closed(known):
    out = {}
    for a, b in sorted(known, reverse=True):
        out.setdefault(a, set()).update({b} | out.get(b, set()))
    return sorted((a, b) for a, ends in out.items() for b in ends)


def test_a_node_is_closed_once_and_an_edge_carries_one_array(spark, monkeypatch):
    """Rows met in the rounds: one array a node, where doubling has a row a pair."""
    added = []
    append = PlacedTable.append

    def watched(self, frame, *measures):
        if frame.columns == ["src", "dsts"]:
            added.append(frame.count())
        assert "hops" not in frame.columns
        return append(self, frame, *measures)

    monkeypatch.setattr(PlacedTable, "append", watched)
    known = acyclic(1)
    edges = spark.createDataFrame(known + [(None, "v01"), ("v01", None)] + known[:3], "src string, dst string")
    assert rows(G.transitive_closure(edges)) == closed(known)
    assert sum(added) == len({a for a, _ in known}) and len(added) > 3


@pytest.mark.parametrize("small", [5, 1_000_000], ids=["placed", "plain"])
@pytest.mark.parametrize("heavy", [4, 100_000], ids=["by name", "by array"])
def test_layers_give_the_closure(spark, monkeypatch, small, heavy):
    monkeypatch.setattr(placed, "SMALL_ROWS", small)
    monkeypatch.setattr(G, "SMALL_ROWS", small * 20)
    monkeypatch.setattr(G, "HEAVY", heavy)
    known = acyclic(2)
    edges = spark.createDataFrame(known, "src string, dst string")
    assert "dsts" in G.packed_reach(edges).columns
    assert rows(G.transitive_closure(edges)) == closed(known)
    seeds = spark.createDataFrame([("v00",), ("v03",), ("v05",), ("v07",), ("none",)], "id string")
    assert rows(G.unpacked(G.packed_reach(edges, seeds))) == [p for p in closed(known) if p[0] in ("v00", "v03", "v05", "v07")]


def test_no_edges_and_cycles(spark):
    assert rows(G.transitive_closure(spark.createDataFrame([], "src string, dst string"))) == []
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert G.packed_reach(ring).columns == ["src", "dst"] and G.transitive_closure(ring).count() == 9


@pytest.mark.parametrize("packed_from", [1, 64])
def test_sessions_meet_packed_reach(spark, monkeypatch, packed_from):
    monkeypatch.setattr(D, "TARGETS_PER_ROW", 2)
    known = acyclic(4)
    reach = G.transitive_closure(spark.createDataFrame(known, "src string, dst string"), packed=True)
    gavs = [[f"v{k:02}" for k in range(0, 30, 2)], ["v01", "v29"], ["v03"], []]
    sessions = spark.createDataFrame([(1, k, 0, 0, g) for k, g in enumerate(gavs)], "clientId int, sessionId long, startTime long, endTime long, gavs array<string>")
    want = sorted({(1, k, b) for k, g in enumerate(gavs) for a, b in closed(known) if a in g and b in g})
    assert rows(D.session_dependencies(sessions, reach, packed_from=packed_from)) == want


@pytest.mark.parametrize("small", [5, 1_000_000], ids=["placed", "plain"])
def test_an_edge_is_met_once_on_the_way_to_its_layer(spark, monkeypatch, small):
    """Rows added in the rounds: the edges, and at most one count an edge; not
    every edge again in each layer below it."""
    monkeypatch.setattr(placed, "SMALL_ROWS", small)
    added = []
    append = PlacedTable.append

    def watched(self, frame, *measures):
        done = append(self, frame, *measures)
        added.append(done[0])
        return done

    monkeypatch.setattr(PlacedTable, "append", watched)
    chain = [(f"v{k}", f"v{k + 1}") for k in range(8)] + [("v0", "v6"), ("w", "v7")]
    layer_of, layers = G._layers(spark.createDataFrame(chain, "src string, dst string"), len(chain))
    assert rows(layer_of) == sorted([(f"v{k}", 8 - k) for k in range(8)] + [("w", 2)]) and layers == 8
    assert sum(added) <= 3 * len(chain)


def test_cycles_and_very_long_paths_have_no_layers(spark, monkeypatch):
    monkeypatch.setattr(G, "MOST_LAYERS", 3)

    def layers(pairs):
        return G._layers(spark.createDataFrame(pairs, "src string, dst string"), len(pairs))

    assert layers([("a", "a")]) is None and layers([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")]) is None
    path = [(f"v{k:02}", f"v{k + 1:02}") for k in range(G.MOST_LAYERS + 1)]
    assert layers(path) is None and layers(path[1:])[1] == G.MOST_LAYERS


def test_names_that_hold_the_separator(spark):
    known = [(f"{a}\x01x", f"{b}\x01x") for a, b in acyclic(5)] + [("a", "b"), ("b", "c\x01"), ("c\x01", "v00\x01x")]
    known = [(b, a) if a > b else (a, b) for a, b in known]
    edges = spark.createDataFrame(known, "src string, dst string")
    assert rows(G.transitive_closure(edges)) == closed(known)


def test_packed_reach_is_met_in_its_buckets(spark, monkeypatch):
    """No join on ``src`` shuffles the arrays, neither with the seeds nor with
    the sessions, whose names do not travel."""
    monkeypatch.setattr(placed, "SMALL_ROWS", 5)
    monkeypatch.setattr(G, "SMALL_ROWS", 100)
    monkeypatch.setattr(D, "FEW_NAMES", 0)
    plans = []

    def watched(frame, inner=placed.staged):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return inner(frame)

    monkeypatch.setattr(D, "staged", watched)
    known = [(f"v{k:02}", f"w{k % 5}") for k in range(20)] + [(f"w{k}", f"x{k % 2}") for k in range(5)]
    gavs = [["v00", "v03", "w0", "x0"], ["v01", "x1"], ["v04", "x1", "w3"], ["v03"]]
    sessions = spark.createDataFrame([(1, k, 0, 0, g) for k, g in enumerate(gavs)], "clientId int, sessionId long, startTime long, endTime long, gavs array<string>")
    edges = spark.createDataFrame(known, "src string, dst string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = D.compute_dependencies(sessions, edges, salt=False)
        assert sorted((r.sessionId, d) for r in got.collect() for d in r.dependencies) == sorted(
            {(k, b) for k, g in enumerate(gavs) for a, b in closed(known) if a in g and b in g}
        )
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    (met,) = [p for p in plans if "arrays_overlap" in p]
    dealt = [line for line in met.splitlines() if "Exchange hashpartitioning(src" in line]
    assert "Bucketed: true" in met and all("dsts" not in below for below in _below(met, dealt))
    assert dealt


def _below(plan, lines):
    """The part of a plan under each of its lines."""
    every = plan.splitlines()
    for line in lines:
        at, depth = every.index(line), line.index("Exchange")
        part = []
        for under in every[at + 1:]:
            if len(under) - len(under.lstrip(" :+-*()0123456789")) <= depth:
                break
            part.append(under)
        yield "\n".join(part)
