"""Randomised checks against brute force on small fixtures."""

from collections import defaultdict, deque

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from depuse.operators import deps as D
from depuse.operators import graph as G
from depuse.operators import sessions as S

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

edge_lists = st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), min_size=1, max_size=18)


def bfs_hops(edges):
    out = defaultdict(set)
    for s, d in edges:
        out[s].add(d)
    result = {}
    for src in {s for s, _ in edges}:
        dist = {}
        queue = deque((d, 1) for d in out[src])
        while queue:
            node, k = queue.popleft()
            if node in dist:
                continue
            dist[node] = k
            queue.extend((n, k + 1) for n in out[node] if n not in dist)
        for dst, k in dist.items():
            result[(f"n{src}", f"n{dst}")] = k
    return result


@SETTINGS
@given(edge_lists, st.one_of(st.none(), st.integers(1, 3)))
def test_reachable_matches_bfs(spark, edges, max_depth):
    df = spark.createDataFrame([(f"n{s}", f"n{d}") for s, d in edges], "src string, dst string")
    want = {k: v for k, v in bfs_hops(edges).items() if max_depth is None or v <= max_depth}
    got = {(r["src"], r["dst"]): r["hops"] for r in G.reachable(df, max_depth=max_depth).collect()}
    assert got == want


downloads = st.lists(
    st.tuples(st.integers(1, 3), st.integers(0, 400), st.sampled_from(["a", "b", "c", "d"])), min_size=1, max_size=25
)


def naive_sessions(rows, max_idle):
    by_client = defaultdict(list)
    for c, t, g in rows:
        by_client[c].append((t, g))
    out = set()
    for c, items in by_client.items():
        items.sort()
        sid, prev, cur = 0, None, []
        for t, g in items:
            if prev is not None and t - prev > max_idle:
                out.add((c, sid, cur[0][0], cur[-1][0], tuple(sorted({x for _, x in cur}))))
                sid, cur = sid + 1, []
            cur.append((t, g))
            prev = t
        out.add((c, sid, cur[0][0], cur[-1][0], tuple(sorted({x for _, x in cur}))))
    return out


@SETTINGS
@given(downloads, st.integers(0, 60))
def test_sessions_match_naive(spark, rows, max_idle):
    df = spark.createDataFrame([(c, t, "x", g, None) for c, t, g in rows],
                               "clientId int, timestamp bigint, agent string, gav string, dependencies array<string>")
    got = {(r[0], r[1], r[2], r[3], tuple(r[4])) for r in S.create_sessions(df, max_idle).collect()}
    assert got == naive_sessions(rows, max_idle)


@SETTINGS
@given(edge_lists, st.lists(st.lists(st.integers(0, 7), min_size=1, max_size=5, unique=True), min_size=1, max_size=4))
def test_session_dependencies_match_brute_force(spark, edges, sessions):
    reach = bfs_hops(edges)
    df_edges = spark.createDataFrame([(f"n{s}", f"n{d}") for s, d in edges], "src string, dst string")
    data = [(1, i, 0, 0, [f"n{g}" for g in gavs]) for i, gavs in enumerate(sessions)]
    sess = spark.createDataFrame(data, "clientId int, sessionId bigint, startTime bigint, endTime bigint, gavs array<string>")
    got = {r["sessionId"]: r["dependencies"] for r in D.compute_dependencies(sess, df_edges, depth=0).collect()}
    for i, gavs in enumerate(sessions):
        names = [f"n{g}" for g in gavs]
        want = sorted({h for h in names if any((g, h) in reach for g in names)})
        assert got[i] == want
