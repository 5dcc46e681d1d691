"""Path totals on graphs with cycles: components against listed trails."""

import pytest

from tests.conftest import rows
from depuse.operators import deps as D
from depuse.operators import graph as G
from tests.test_graph import random_edges

EDGES = "src string, dst string"


def all_trails(known, start, bound=None):
    """(end, length) of every edge-simple path from ``start``."""
    out = {}
    for a, b in known:
        out.setdefault(a, []).append(b)
    stack = [(start, frozenset())]
    while stack:
        node, used = stack.pop()
        for b in out.get(node, []):
            if (node, b) not in used and (bound is None or len(used) < bound):
                yield b, len(used) + 1
                stack.append((b, used | {(node, b)}))


def totals(pairs):
    seen = {}
    for key, length in pairs:
        n, w = seen.get(key, (0, 0))
        seen[key] = (n + 1, w + length)
    return sorted((*key, n, w) for key, (n, w) in seen.items())


def components_by_closure(known):
    nodes = {v for e in known for v in e}
    reach = {v: {b for b, _ in all_trails(known, v)} for v in nodes}
    return sorted((a, b) for a, b in known if a == b or a in reach[b])


@pytest.mark.parametrize("seed", range(3))
def test_component_edges_match_mutual_reach(spark, seed):
    known = random_edges(seed, 9, 14)
    assert rows(G.component_edges(spark.createDataFrame(known, EDGES))) == components_by_closure(known)


def test_component_edges_of_cycles_in_a_row(spark):
    # Three rings joined by bridges, a loop on a tail, a tail in and a tail out.
    rings = [(f"r{k}{a}", f"r{k}{(a + 1) % 3}") for k in range(3) for a in range(3)]
    rest = [("in", "r00"), ("r01", "r10"), ("r12", "r20"), ("r00", "r22"), ("r21", "self"), ("self", "out")]
    edges = spark.createDataFrame(rings + rest + [("self", "self")], EDGES)
    assert rows(G.component_edges(edges)) == sorted(rings + [("self", "self")])
    assert G.component_edges(edges.filter("src = 'in'")).count() == 0
    assert G.component_edges(edges.limit(0)).count() == 0


@pytest.mark.parametrize("seed,bound", [(1, None), (2, 5)])
def test_components_match_listed_trails(spark, seed, bound):
    known = random_edges(seed, 7, 10) + [("x", "x")]
    nodes = sorted({v for e in known for v in e})
    edges, seeds = spark.createDataFrame(known, EDGES), spark.createDataFrame([(v,) for v in nodes], "id string")
    work = G.traversal_work(edges, seeds, max_depth=bound, mode="components")
    assert rows(work) == totals(((v,), k) for v in nodes for _, k in all_trails(known, v, bound))
    targets = nodes[::2]
    pairs = G.traversal_pairs(edges, seeds, spark.createDataFrame([(v,) for v in targets], "id string"), bound, "components")
    assert rows(pairs, "seed", "node", "n_paths", "work") == totals(
        ((v, b), k) for v in nodes for b, k in all_trails(known, v, bound) if b in targets
    )


def test_small_cycle_before_very_many_paths(spark):
    """Every way through the acyclic part is counted, none is listed."""
    width, links = 900, 3
    chain = [e for k in range(links) for m in range(width) for e in ((f"c{k}", f"m{k}.{m}"), (f"m{k}.{m}", f"c{k + 1}"))]
    known = chain + [("a", "b"), ("b", "a"), ("b", "c0")]
    seeds = [("a",), ("b",)]
    edges = spark.createDataFrame(known, EDGES)
    got = G.traversal_pairs(
        edges, spark.createDataFrame(seeds, "id string"), spark.createDataFrame([(f"c{links}",)], "id string"), mode="components"
    )
    ways, long = width**links, 2 * links
    # a: ab c0...; b: b c0..., bab c0...
    assert rows(got, "seed", "n_paths", "work") == [("a", ways, ways * (long + 2)), ("b", 2 * ways, ways * (long + 1) + ways * (long + 3))]


def test_sessions_on_a_cycle_without_a_bound(spark):
    known = [("a", "b"), ("b", "c"), ("c", "b"), ("a", "d"), ("c", "d")]
    sessions = [(1, 1, ["a", "d"]), (1, 2, ["c"]), (2, 1, ["a", "b", "c", "d"]), (2, 2, [])]
    frame = spark.createDataFrame(sessions, "clientId int, sessionId int, gavs array<string>")
    got = D.session_traversal_work(frame, spark.createDataFrame(known, EDGES), mode="components")
    want = []
    for client, session, gavs in sessions:
        inside = [k for g in gavs for b, k in all_trails(known, g) if b in gavs]
        want.append((client, session, len(inside), sum(inside)))
    assert rows(got) == sorted(want)
