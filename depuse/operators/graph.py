"""Dependency graph as DataFrames: ``nodes(id)``, ``edges(src, dst)``.

Reachability is a fixpoint over placed tables (``placed``): the pairs found lie
in buckets of their hash, a round shuffles only what is new and looks it up in
place.  From few seeds, each round adds one hop to the last round's pairs;
from all or most nodes, distances double (``_doubled``), or, where hop counts
are not asked for and there is no cycle, nodes go layer by layer with their
targets as arrays (``packed_reach``).  Every round's pairs
are files under the cluster's ``spark.checkpoint.dir``, so the lineage of round
k never reaches back to round 1 and a lost executor costs a re-read.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depuse.functions.sentinels import is_sentinel_only, strip_sentinels
from depuse.operators.placed import LEVEL, SMALL_ROWS, PlacedTable, staged
from depuse.operators.skew import hot_keys, salted_join
from depuse.session import ensure_checkpoint_dir
from depuse.sources.text import DIRECT_EDGE_TYPE, EDGE_HEADER, GRAPH_DELIMITER, NODE_HEADER, TRANSITIVE_EDGE_TYPE

# Seeds that are at least this share of all nodes are met by doubling distances.
SEED_SHARE = 0.1

# Fewest edges and longest path of a graph whose closure goes layer by layer;
# names that the arrays of one source may hold when they are united in one row.
LAYERED_FROM = 10_000
MOST_LAYERS = 32
HEAVY = 100_000
SEPARATOR = "\x01"  # of names in a text

# Node label of the graph files, edges in one of them at most.
NODE_LABEL = "GAV"
EDGES_PER_FILE = 2_000_000


def materialise(df: DataFrame) -> DataFrame:
    """Reliable, eager checkpoint (cuts lineage; survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialise_counted(df: DataFrame, measure: Column | None = None) -> tuple[DataFrame, int]:
    """``materialise`` that also returns the number of rows (or another count),
    observed while the checkpoint is computed (no extra job)."""
    ensure_checkpoint_dir(df.sparkSession)
    seen = Observation()
    measure = F.count(F.lit(1)) if measure is None else measure
    done = df.observe(seen, measure.alias("rows")).checkpoint(eager=True)
    return done, int(seen.get["rows"] or 0)


def _union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b), frames)


# -- building the graph from dependency records ------------------------------


def retained_records(records: DataFrame) -> DataFrame:
    """Records that contribute to the graph, sentinels removed from the lists.

    A record whose only dependency is a sentinel is dropped entirely; a mixed
    list loses its sentinels; a list of several sentinels (or an empty list)
    keeps the record as an isolated node.
    """
    deps = F.col("dependencies")
    return records.filter(~is_sentinel_only(deps)).withColumn("dependencies", strip_sentinels(deps))


def direct_edges(records: DataFrame) -> DataFrame:
    """Distinct ``src, dst``: repeated gavs union their dependency lists."""
    kept = retained_records(records)
    return kept.select(F.col("gav").alias("src"), F.explode("dependencies").alias("dst")).distinct()


def graph_nodes(records: DataFrame) -> DataFrame:
    """Distinct ``id``: gavs of retained records and all their dependencies."""
    kept = retained_records(records)
    return (
        kept.select(F.col("gav").alias("id"))
        .unionByName(kept.select(F.explode("dependencies").alias("id")))
        .distinct()
    )


def build_graph(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the records."""
    return graph_nodes(records), direct_edges(records)


def validate_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two endpoints are both nodes (distinct)."""
    ids = nodes.select(F.col("id"))
    return (
        edges.select("src", "dst")
        .join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
        .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        .select("src", "dst")
        .distinct()
    )


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row ``nodes, edges`` (counts), computed in a single aggregation."""
    tagged = nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(
        edges.select(F.lit(0).alias("n"), F.lit(1).alias("e"))
    )
    return tagged.agg(F.sum("n").cast("bigint").alias("nodes"), F.sum("e").cast("bigint").alias("edges"))


# -- reachability --------------------------------------------------------------


def expand(frontier: DataFrame, edges: DataFrame, salt: bool = False) -> DataFrame:
    """One traversal step: ``(src, dst)`` pairs one edge beyond ``frontier``.

    The join key is the intermediate node; one that many sources reach is a
    hot key.  By default AQE's skew-join rule splits its partition at run
    time (no extra pass); ``salt`` spreads it explicitly instead.
    """
    left = frontier.select("src", F.col("dst").alias("_mid"))
    right = edges.select(F.col("src").alias("_mid"), "dst")
    step = salted_join(left, right, ["_mid"]) if salt else left.join(right, "_mid")
    return step.select("src", "dst").distinct()


def encode_nodes(edges: DataFrame) -> tuple[DataFrame, int]:
    """``id, nid``: a distinct long for every node of ``edges``; and how many.

    The loops join, sort and compare node pairs many times; longs are
    smaller than gav strings and sort by radix (gavs share long prefixes, so
    string sorts fall back to full comparisons).  The table is materialised,
    which fixes the ids for every later use.
    """
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return materialise_counted(ids.withColumn("nid", F.monotonically_increasing_id()))


def _encode_edges(edges: DataFrame, ids: DataFrame, salt: bool = False) -> DataFrame:
    """Gavs to long ids; ``salt`` spreads a ``dst`` that very many depend on."""
    by_src = ids.select(F.col("id").alias("src"), F.col("nid").alias("s"))
    by_dst = ids.select(F.col("id").alias("dst"), F.col("nid").alias("d"))
    with_src = edges.join(by_src, "src")
    both = salted_join(with_src, by_dst, ["dst"]) if salt else with_src.join(by_dst, "dst")
    return both.select(F.col("s").alias("src"), F.col("d").alias("dst"))


def _decode_pairs(pairs: DataFrame, ids: DataFrame, salt: bool = False) -> DataFrame:
    """Long ids back to gavs.  A node that most sources reach (a library
    everything depends on) is a hot ``dst`` key; ``salt`` spreads it."""
    by_src = ids.select(F.col("nid").alias("src"), F.col("id").alias("_s"))
    by_dst = ids.select(F.col("nid").alias("dst"), F.col("id").alias("_d"))
    rest = [c for c in pairs.columns if c not in ("src", "dst")]
    with_src = pairs.join(by_src, "src")
    both = salted_join(with_src, by_dst, ["dst"]) if salt else with_src.join(by_dst, "dst")
    return both.select(F.col("_s").alias("src"), F.col("_d").alias("dst"), *rest)


def reachable(
    edges: DataFrame,
    seeds: DataFrame | None = None,
    max_depth: int | None = None,
    salt: bool = False,
) -> DataFrame:
    """``src, dst, hops``: every ``dst`` reachable from ``src`` by 1 or more
    edges, with the least number of edges (``hops``).

    ``seeds`` (a DataFrame with column ``id``) restricts the sources before
    the loop; ``max_depth`` stops after that many hops (None = until no new
    pair appears, which always happens, cycles included).  A node on a cycle
    reaches itself.  The loop runs on long node ids (``encode_nodes``) and
    the result is decoded back to gavs.

    Hot nodes (many sources reach the same intermediate node or target) are
    split at run time by AQE's skew-join rule, which needs the many map tasks
    of a large input; ``salt=True`` salts them explicitly every round at the
    cost of one small aggregation per round (see docs/SKEW.md).
    """
    if max_depth is not None and max_depth < 1:
        raise ValueError("max_depth must be >= 1 (or None for unbounded)")
    edges = edges.select("src", "dst")
    ids, nodes = encode_nodes(edges)
    graph = _encode_edges(edges, ids, salt=salt).distinct()
    if seeds is None:
        return _decode_pairs(_doubled(graph, max_depth, salt), ids, salt=salt)
    seed_ids = ids.join(seeds.select("id").distinct(), "id", "left_semi").select(F.col("nid").alias("src"))
    seed_ids, starts = materialise_counted(seed_ids)
    if starts >= SEED_SHARE * nodes:
        pairs = _doubled(graph, max_depth, salt).join(seed_ids, "src", "left_semi")
    else:
        pairs = _by_frontier(graph, seed_ids, max_depth, salt)
    return _decode_pairs(pairs, ids, salt=salt)


def _by_frontier(graph: DataFrame, seed_ids: DataFrame, max_depth: int | None, salt: bool) -> DataFrame:
    """``src, dst, hops`` from the seeds, one hop a round.  The edges lie in
    buckets of ``src``, the pairs found in buckets of (src, dst)."""
    spark = graph.sparkSession
    edges, found = PlacedTable(spark, ["src"]), PlacedTable(spark, ["src", "dst"])
    edges.append(graph)
    first = edges.all().join(seed_ids, "src", "left_semi")
    (rows,) = found.append(first.withColumn("hops", F.lit(1)))
    depth = 1
    while rows and (max_depth is None or depth < max_depth):
        step = expand(found.level(depth - 1), edges.all(), salt=salt)
        fresh = step.join(found.all().select("src", "dst"), ["src", "dst"], "left_anti")
        depth += 1
        (rows,) = found.append(fresh.withColumn("hops", F.lit(depth)))
    edges.close()
    return found.close()


def _doubled(graph: DataFrame, max_depth: int | None = None, salt: bool = False) -> DataFrame:
    """``src, dst, hops`` from every node, least hops, in about log2 of the
    longest distance rounds.

    With all distances up to ``span`` known, a pair that is up to twice as far
    apart has a node exactly ``span`` from its start on a shortest path.  So a
    round joins only the pairs at exactly that distance (a part of the last
    round's) with all known ones: a pair is met once per such node, never
    through the closure joined with itself.  Pairs lie twice, by ``src`` for the
    join and by (src, dst) to be looked up; a round shuffles what it finds.
    On cycles this is no more work: every pair is part of the result, so merging
    a cycle's nodes first would not make it smaller.
    """
    spark = graph.sparkSession
    known, by_src = PlacedTable(spark, ["src", "dst"]), PlacedTable(spark, ["src"], small=0)
    longest = F.max("hops")
    rows, most = known.append(graph.withColumn("hops", F.lit(1)), longest)
    span, level = 1, 0
    while rows and most == span and (max_depth is None or span < max_depth):
        while known.placed and by_src.levels <= level:
            by_src.append(known.level(by_src.levels))
        far = known.level(level).filter(F.col("hops") == span).select("src", F.col("dst").alias("_mid"))
        near = (by_src if known.placed else known).all().select(F.col("src").alias("_mid"), "dst", F.col("hops").alias("_more"))
        if max_depth is not None:
            near = near.filter(F.col("_more") <= max_depth - span)
        met = salted_join(far, near, ["_mid"]) if salt else far.join(near, "_mid")
        found = met.groupBy("src", "dst").agg((F.min("_more") + F.lit(span)).alias("hops"))
        fresh = found.join(known.all().select("src", "dst"), ["src", "dst"], "left_anti")
        rows, most = known.append(fresh, longest)
        span, level = 2 * span, level + 1
    if by_src.levels:
        by_src.close()
    return known.close()


def transitive_closure(edges: DataFrame, salt: bool = False, packed: bool = False) -> DataFrame:
    """Exact closure ``src, dst`` of the edges (all sources); ``packed`` leaves
    it as ``packed_reach`` has it."""
    reach = packed_reach(edges, salt=salt, in_place=packed)
    return reach if packed else unpacked(reach)


def unpacked(reach: DataFrame) -> DataFrame:
    """Reachability as ``src, dst`` (see ``packed_reach``)."""
    return reach.select("src", F.explode("dsts").alias("dst")) if "dsts" in reach.columns else reach.select("src", "dst")


def packed_reach(
    edges: DataFrame, seeds: DataFrame | None = None, salt: bool = False, in_place: bool = True
) -> DataFrame:
    """Unbounded reach without hop counts: ``src, dsts ARRAY<STRING>`` (every
    target of ``src`` in one of its rows), or ``src, dst`` as ``reachable`` has it
    where the graph is small, the seeds are few, or there is a cycle or a very
    long path.

    Without cycles a node reaches its heads and what these reach, so nodes are
    taken by the length of their longest path, each once, when all its heads are
    done.  A node's targets travel as arrays, one row an edge, not a row a pair.
    ``in_place`` leaves the arrays in their buckets of ``src``, so that a join on
    ``src`` does not shuffle them; the session's catalog keeps their entry.
    """
    graph, rows = materialise_counted(edges.select("src", "dst").dropna().distinct())
    if rows < LAYERED_FROM:
        return reachable(graph, seeds=seeds, salt=salt).select("src", "dst")
    if seeds is not None:
        seeds = staged(seeds.select("id").distinct())
        nodes = graph.select(F.col("src").alias("id")).unionByName(graph.select(F.col("dst").alias("id"))).distinct()
        starts = F.count(F.col("_seed"))
        counts = nodes.join(seeds.withColumn("_seed", F.lit(1)), "id", "left").agg(F.count(F.lit(1)).alias("n"), starts.alias("s")).collect()[0]
        if counts["s"] < SEED_SHARE * counts["n"]:
            return reachable(graph, seeds=seeds, salt=salt).select("src", "dst")
    layers = _layers(graph, rows)
    if layers is None:
        return reachable(graph, seeds=seeds, salt=salt).select("src", "dst")
    reach = _by_layers(graph, *layers, in_place)
    return reach if seeds is None else reach.join(seeds.withColumnRenamed("id", "src"), "src", "left_semi")


def _layers(graph: DataFrame, rows: int) -> tuple[DataFrame, int] | None:
    """``src, layer`` (edges of the longest path from ``src``) and the number of
    layers; None if there is a cycle or a path of more than ``MOST_LAYERS``.

    A node is closed when all its heads are.  A round sends the nodes just
    closed to the edges that lead to them and adds how many heads that closed
    for each source, so an edge is met once, not in every layer below it."""
    spark = graph.sparkSession
    edges, heads, closed, left = PlacedTable(spark, ["dst"]), PlacedTable(spark, ["src"]), [], 0
    if rows:
        edges.append(graph)
        (left,) = heads.append(graph.groupBy("src").agg(F.count(F.lit(1)).alias("n")))
        ends = edges.all().select(F.col("dst").alias("src")).distinct()
        last = materialise(ends.join(heads.all().select("src").hint("shuffle_hash"), "src", "left_anti"))
    while left and len(closed) < MOST_LAYERS:
        met = edges.all().join(last.withColumnRenamed("src", "dst").hint("shuffle_hash"), "dst")
        heads.append(met.groupBy("src").agg((-F.count(F.lit(1))).alias("n")))
        touched = heads.level(heads.levels - 1).select("src").hint("shuffle_hash")
        done = heads.all().groupBy("src").agg(F.sum("n").alias("n")).filter(F.col("n") == 0)
        last, found = materialise_counted(done.select("src").join(touched, "src", "left_semi"))
        if not found:
            break
        closed.append(last.withColumn("layer", F.lit(len(closed) + 1)))
        left -= found
    if rows:
        edges.close()
        heads.close()
    if left:
        return None
    none = graph.select("src", F.lit(0).alias("layer")).filter(F.lit(False))
    return materialise(_union_all(closed).coalesce(edges.buckets)) if closed else none, len(closed)


def _by_layers(graph: DataFrame, layer_of: DataFrame, layers: int, in_place: bool) -> DataFrame:
    """``src, dsts`` of an acyclic graph, layer by layer.  The rows done lie in
    buckets of ``src`` and are looked up in place; what is shuffled is one array
    an edge.  Sources that many arrays meet go by ``_merged_heavy``."""
    spark = graph.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/layers-{uuid.uuid4().hex}"
    graph.join(layer_of, "src").write.partitionBy("layer").parquet(path)
    schema = T.StructType([*graph.schema.fields, T.StructField("layer", T.IntegerType())])
    placed = spark.read.schema(schema).parquet(path)
    hot, hots = materialise_counted(hot_keys(graph, ["dst"]))
    most = graph.groupBy("src").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).collect()[0][0] or 0
    as_text = graph.filter(F.col("dst").contains(SEPARATOR)).isEmpty()
    done, longest = PlacedTable(spark, ["src"], small=SMALL_ROWS // 20), 0
    for layer in range(1, layers + 1):
        step = placed.filter(F.col("layer") == layer).select("src", "dst")
        heads = step.select("src", F.array("dst").alias("dsts"))
        parts = heads
        if layer > 1:
            known = done.all().select(F.col("src").alias("dst"), "dsts")
            usual = step
            if hots:
                usual = step.join(F.broadcast(hot), "dst", "left_anti")
                common = salted_join(step.join(F.broadcast(hot), "dst", "left_semi"), known.join(F.broadcast(hot), "dst", "left_semi"), ["dst"])
                parts = parts.unionByName(common.select("src", "dsts"))
            parts = parts.unionByName(known.join(usual.hint("shuffle_hash"), "dst").select("src", "dsts"))
        merged = _merged(parts, as_text) if most * (longest + 1) <= HEAVY else _merged_heavy(materialise(parts), as_text)
        _, size = done.append(merged, F.max(F.size("dsts")))
        longest = max(longest, size or 0) if most * (longest + 1) <= HEAVY else HEAVY
    if not layers:
        return graph.select("src", F.array("dst").alias("dsts"))
    return done.all() if in_place else done.close()


def _merged(parts: DataFrame, as_text: bool) -> DataFrame:
    """``src, dsts``: arrays of a source united in one row.  They travel ``as_text``,
    which takes half the bytes, unless a name contains ``SEPARATOR``."""
    if not as_text:
        return parts.groupBy("src").agg(F.array_distinct(F.flatten(F.collect_list("dsts"))).alias("dsts"))
    texts = parts.select("src", F.array_join("dsts", SEPARATOR).alias("dsts")).groupBy("src").agg(F.collect_list("dsts").alias("dsts"))
    return texts.select("src", F.array_distinct(F.split(F.array_join("dsts", SEPARATOR), SEPARATOR)).alias("dsts"))


def _merged_heavy(parts: DataFrame, as_text: bool) -> DataFrame:
    """``_merged``, but a source whose arrays hold more than ``HEAVY`` names is
    united name by name, into rows of about ``HEAVY / 10``."""
    sizes = parts.groupBy("src").agg(F.sum(F.size("dsts")).alias("_n")).filter(F.col("_n") > HEAVY)
    sizes = materialise(sizes)
    usual = _merged(parts.join(sizes, "src", "left_anti"), as_text)
    names = parts.join(sizes.select("src"), "src", "left_semi").select("src", F.explode("dsts").alias("dst")).distinct()
    piece = F.pmod(F.xxhash64("dst"), F.ceil(F.col("_n") * 10 / F.lit(HEAVY)))
    heavy = names.join(sizes, "src").groupBy("src", piece.alias("_piece")).agg(F.collect_list("dst").alias("dsts"))
    return usual.unionByName(heavy.select("src", "dsts"))


# -- traversal work --------------------------------------------------------------


def traversal_work(
    edges: DataFrame,
    seeds: DataFrame,
    max_depth: int | None = None,
    mode: str = "auto",
) -> DataFrame:
    """Per seed ``id``: number of edge-simple paths (no edge used twice) of
    length >= 1 leaving it (``n_paths``) and the sum of their lengths
    (``work``), paths up to ``max_depth`` edges if given.

    ``mode="counts"`` counts paths per (seed, node, length) without listing
    them: on an acyclic graph every walk is edge-simple, so this is exact, and
    its size is bounded by seeds x nodes per level.  It refuses a graph with a
    cycle that the seeds reach.  ``"trails"`` extends each path, carrying the
    ids of the edges it used: exact on any graph and as large as the number of
    paths, so on a cyclic graph it asks for ``max_depth``.  ``"components"``
    lists trails only inside strongly connected components and counts between
    them (``_work_by_components``): exact on any graph, with or without
    ``max_depth``, and as large as the trails of single components.  ``"auto"``
    looks for a cycle first and chooses ``"counts"`` or ``"components"``; on a
    cyclic graph it asks for ``max_depth``, as the trails of one large component
    can be very many.
    """
    graph = materialise(edges.select("src", "dst").distinct())
    ids = materialise(seeds.select(F.col("id").alias("seed")).distinct())
    return _path_totals(graph, ids, max_depth, mode, None).withColumnRenamed("seed", "id")


def traversal_pairs(
    edges: DataFrame,
    seeds: DataFrame,
    targets: DataFrame,
    max_depth: int | None = None,
    mode: str = "auto",
) -> DataFrame:
    """``seed, node, n_paths, work`` per seed and target ``node``: number and
    summed length of the edge-simple paths from the one to the other; pairs
    without a path are left out.  ``mode`` and ``max_depth`` as in
    ``traversal_work``.

    Only edges that the seeds reach and that lead to a target take part, so
    paths that end nowhere in the targets are not followed to their ends, and
    only cycles between seeds and targets count as cycles.
    """
    graph = materialise(edges.select("src", "dst").distinct())
    ids = materialise(seeds.select(F.col("id").alias("seed")).distinct())
    ends = materialise(targets.select(F.col("id").alias("node")).distinct())
    ahead = _reached(graph, ids.select(F.col("seed").alias("id")))
    back = _reached(ahead.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ends.select(F.col("node").alias("id")))
    between = materialise(back.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct())
    return _path_totals(between, ids, max_depth, mode, ends)


def _path_totals(
    graph: DataFrame, ids: DataFrame, max_depth: int | None, mode: str, ends: DataFrame | None
) -> DataFrame:
    """Path totals per seed, or per seed and node of ``ends``."""
    if mode not in ("auto", "counts", "trails", "components"):
        raise ValueError("mode must be 'auto', 'counts', 'trails' or 'components'")
    if max_depth is not None and max_depth < 1:
        raise ValueError("max_depth must be >= 1")
    if mode == "trails" and max_depth is not None:
        return _work_by_trails(graph, ids, max_depth, ends)
    ahead = _reached(graph, ids.select(F.col("seed").alias("id")))
    core, cyclic = _peeled(ahead)
    if cyclic and mode == "counts":
        raise ValueError("a cycle is reachable from the seeds: use mode='components'")
    if cyclic and mode != "components" and max_depth is None:
        raise ValueError("a cycle is reachable from the seeds: give max_depth, or use mode='components'")
    if cyclic:
        return _work_by_components(ahead, core, ids, max_depth, ends)
    if mode == "trails":
        return _work_by_trails(graph, ids, max_depth, ends)
    return _work_by_counts(graph, ids, max_depth, ends)


def _reached(graph: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges leaving the seeds or any node they reach.  Nodes found lie in
    buckets and are looked up in place, like the edges."""
    edges, nodes = PlacedTable(graph.sparkSession, ["src"]), PlacedTable(graph.sparkSession, ["src"])
    edges.append(graph)
    (rows,) = nodes.append(seeds.select(F.col("id").alias("src")).distinct())
    while rows:
        last = nodes.level(nodes.levels - 1).hint("shuffle_hash")
        heads = edges.all().join(last, "src", "left_semi").select(F.col("dst").alias("src")).distinct()
        (rows,) = nodes.append(heads.join(nodes.all().hint("merge"), "src", "left_anti"))
    met = materialise(edges.all().join(nodes.all().hint("merge"), "src", "left_semi"))
    edges.close()
    nodes.close()
    return met


def reaches_cycle(graph: DataFrame, seeds: DataFrame) -> bool:
    """Whether the seeds reach a cycle."""
    return _peeled(_reached(graph, seeds))[1] > 0


def _peeled(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges on or between cycles, and how many.  Edges that start at a node
    nothing leads to, or end at a node nothing leaves, are peeled off until none
    is left (no cycle) or no more can go."""
    left, rows = materialise_counted(edges.select("src", "dst").distinct())
    before = None
    while rows and rows != before:
        kept = left.join(left.select(F.col("src").alias("dst")).distinct().hint("merge"), "dst", "left_semi")
        kept = kept.join(left.select(F.col("dst").alias("src")).distinct().hint("merge"), "src", "left_semi")
        before, (left, rows) = rows, materialise_counted(kept.select("src", "dst"))
    return left, rows


def component_edges(edges: DataFrame) -> DataFrame:
    """The ``src, dst`` whose ends lie in one strongly connected component, that
    is, the edges that are on a cycle.

    Every node learns the least node id that leads to it and the least that it
    leads to.  Nodes of one component agree in both; edges whose ends do not are
    dropped, until all agree.  Then the least node of each connected part leads
    to all of it and all of it leads to that node, so the part is a component.
    Rounds follow the longest way that a least id travels.
    """
    core, rows = _peeled(edges)
    if not rows:
        return core
    ids, _ = encode_nodes(core)
    left, rows = materialise_counted(_encode_edges(core, ids))
    before = None
    while rows != before:
        ahead = _least_leading(left)
        back = _least_leading(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        seen = ahead.join(back.withColumnRenamed("least", "last"), "node")
        by_src = seen.select(F.col("node").alias("src"), F.struct("least", "last").alias("_s"))
        by_dst = seen.select(F.col("node").alias("dst"), F.struct("least", "last").alias("_d"))
        kept = left.join(by_src, "src").join(by_dst, "dst").filter(F.col("_s") == F.col("_d"))
        before, (left, rows) = rows, materialise_counted(kept.select("src", "dst"))
    return materialise(_decode_pairs(left, ids))


def _least_leading(edges: DataFrame) -> DataFrame:
    """``node, least``: the least node that leads to each node, itself included.
    A round sends only the values that the last one lowered; they are added to
    those known, which stay in their buckets."""
    spark = edges.sparkSession
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    steps, known = PlacedTable(spark, ["src"]), PlacedTable(spark, ["node"])
    steps.append(edges.select("src", "dst"))
    (lowered,) = known.append(nodes.select("node", F.col("node").alias("least")))
    least = F.min("least").alias("least")
    while lowered:
        sent = known.level(known.levels - 1).withColumnRenamed("node", "src").hint("shuffle_hash")
        offers = steps.all().join(sent, "src").groupBy(F.col("dst").alias("node")).agg(least)
        best = known.all().groupBy("node").agg(F.min("least").alias("_best"))
        lower = best.join(offers.hint("shuffle_hash"), "node").filter(F.col("least") < F.col("_best"))
        (lowered,) = known.append(lower.select("node", "least"))
    found = materialise(known.all().groupBy("node").agg(least))
    steps.close()
    known.close()
    return found


def _level_totals(level: DataFrame, length: int, weight: str | None, ends: DataFrame | None) -> DataFrame:
    n = F.col(weight) if weight else F.lit(1).cast("bigint")
    keys = ["seed"]
    if ends is not None:
        level, keys = level.join(ends, "node", "left_semi"), ["seed", "node"]
    return level.groupBy(*keys).agg(F.sum(n).alias("n_paths"), (F.sum(n) * F.lit(length)).alias("work"))


def _sum_totals(ids: DataFrame, totals: list, ends: DataFrame | None) -> DataFrame:
    keys = ["seed"] if ends is None else ["seed", "node"]
    none = F.lit(0).cast("bigint")
    if not totals:
        node = [] if ends is None else [F.col("seed").alias("node")]
        return ids.filter(F.lit(False)).select("seed", *node, none.alias("n_paths"), none.alias("work"))
    return _union_all(totals).groupBy(*keys).agg(
        F.sum("n_paths").cast("bigint").alias("n_paths"), F.sum("work").cast("bigint").alias("work")
    )


def _work_by_counts(graph: DataFrame, ids: DataFrame, max_depth: int | None, ends: DataFrame | None) -> DataFrame:
    level, rows = materialise_counted(
        graph.join(ids.withColumnRenamed("seed", "src"), "src", "left_semi")
        .select(F.col("src").alias("seed"), F.col("dst").alias("node"), F.lit(1).cast("bigint").alias("n"))
    )
    totals = []
    length = 1
    while rows:
        totals.append(_level_totals(level, length, "n", ends))
        if max_depth is not None and length >= max_depth:
            break
        length += 1
        step = level.select("seed", F.col("node").alias("_mid"), "n").join(
            graph.select(F.col("src").alias("_mid"), F.col("dst").alias("node")).hint("merge"), "_mid"
        )
        level, rows = materialise_counted(step.groupBy("seed", "node").agg(F.sum("n").alias("n")))
    return _sum_totals(ids, totals, ends)


def _work_by_trails(graph: DataFrame, ids: DataFrame, max_depth: int | None, ends: DataFrame | None) -> DataFrame:
    totals = [_level_totals(level, length, None, ends) for length, level in _trail_levels(graph, ids, max_depth)]
    return _sum_totals(ids, totals, ends)


def _trail_levels(graph: DataFrame, ids: DataFrame, max_depth: int | None) -> Iterator[tuple[int, DataFrame]]:
    """Length by length, one row ``seed, node, used`` per edge-simple path."""
    numbered = materialise(graph.withColumn("eid", F.monotonically_increasing_id()))
    level, rows = materialise_counted(
        numbered.join(ids.withColumnRenamed("seed", "src"), "src", "left_semi").select(
            F.col("src").alias("seed"), F.col("dst").alias("node"), F.array("eid").alias("used")
        )
    )
    length = 1
    while rows:
        yield length, level
        if max_depth is not None and length >= max_depth:
            return
        length += 1
        step = level.select("seed", F.col("node").alias("_mid"), "used").join(
            numbered.select(F.col("src").alias("_mid"), F.col("dst").alias("node"), "eid"), "_mid"
        )
        fresh = step.filter(~F.array_contains("used", F.col("eid"))).select(
            "seed", "node", F.concat("used", F.array("eid")).alias("used")
        )
        level, rows = materialise_counted(fresh)


def _work_by_components(
    graph: DataFrame, core: DataFrame, ids: DataFrame, max_depth: int | None, ends: DataFrame | None
) -> DataFrame:
    """Path totals on a graph with cycles.

    A path that leaves a component never comes back, so it is a trail inside one
    component, an edge to the next, a trail inside that, and so on; only the
    trails inside can meet an edge twice.  Those are listed once per entry of a
    component, whatever the number of seeds, and reduced to ``n`` trails of total
    length ``w`` per (entry, exit).  Between components, paths are counted per
    (seed, node): n and w of two parts make n1 n2 and w1 n2 + n1 w2.  Lengths are
    told apart (``len``, else 0) only where ``max_depth`` has to.
    """
    inside = component_edges(core)
    across = materialise(graph.select("src", "dst").join(inside, ["src", "dst"], "left_anti"))
    starts = ids.select(F.col("seed").alias("node")).unionByName(across.select(F.col("dst").alias("node")))
    entries = materialise(starts.join(inside.select(F.col("src").alias("node")), "node", "left_semi").distinct())
    trips = _component_trips(inside, entries.withColumnRenamed("node", "seed"), max_depth)
    step = 0 if max_depth is None else 1
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    sums = [F.sum("n").alias("n"), F.sum("w").alias("w")]
    arrived = ids.select("seed", F.col("seed").alias("node"), F.lit(0).alias("len"), one.alias("n"), zero.alias("w"))
    # The path of no edges is counted with the first round; here it goes again.
    totals = [_ended(arrived.withColumn("n", -one), ends)]
    while True:
        fits = F.col("node") == F.col("_entry")
        if max_depth is not None:
            fits = fits & (F.col("len") + F.col("_len") <= max_depth)
        more, many = F.coalesce("_w", zero), F.coalesce("_n", one)
        met = arrived.join(trips, fits, "left").select(
            "seed", F.coalesce("_exit", "node").alias("node"), (F.col("len") + F.coalesce("_len", F.lit(0))).alias("len"),
            (F.col("n") * many).alias("n"), (F.col("w") * many + F.col("n") * more).alias("w"),
        )
        at, rows = materialise_counted(met.groupBy("seed", "node", "len").agg(*sums))
        if not rows:
            return _sum_totals(ids, totals, ends).filter("n_paths > 0")
        totals.append(_ended(at, ends))
        onward = at if max_depth is None else at.filter(F.col("len") < max_depth)
        arrived = (
            onward.withColumnRenamed("node", "src").join(across, "src")
            .select("seed", F.col("dst").alias("node"), (F.col("len") + step).alias("len"), "n", (F.col("w") + F.col("n")).alias("w"))
            .groupBy("seed", "node", "len").agg(*sums)
        )


def _ended(paths: DataFrame, ends: DataFrame | None) -> DataFrame:
    """Paths ``seed, node, n, w`` as totals per seed, or per seed and end."""
    keys = ["seed"]
    if ends is not None:
        paths, keys = paths.join(ends, "node", "left_semi"), ["seed", "node"]
    return paths.groupBy(*keys).agg(F.sum("n").alias("n_paths"), F.sum("w").alias("work"))


def _component_trips(inside: DataFrame, entries: DataFrame, max_depth: int | None) -> DataFrame:
    """``_entry, _exit, _len, _n, _w``: the trails inside components from each
    entry (column ``seed``), the one of no edges included."""
    trips = [entries.select("seed", F.col("seed").alias("node"), F.lit(0).alias("len"), F.lit(1).cast("bigint").alias("n"))]
    for length, level in _trail_levels(inside, entries, max_depth):
        counted = level.groupBy("seed", "node").agg(F.count(F.lit(1)).alias("n"))
        trips.append(counted.select("seed", "node", F.lit(length).alias("len"), "n"))
    kept = F.lit(0) if max_depth is None else F.col("len")
    return materialise(
        _union_all(trips).groupBy(F.col("seed").alias("_entry"), F.col("node").alias("_exit"), kept.alias("_len"))
        .agg(F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("len")).alias("_w"))
    )


# -- graph files -------------------------------------------------------------------


def write_graph(
    nodes: DataFrame,
    edges: DataFrame,
    nodes_path: str,
    edges_path: str,
    closure: DataFrame | None = None,
) -> None:
    """Pipe-delimited node and edge files with headers, nodes sorted by id.

    The direct edges are always written; a ``closure`` goes beside them under
    its own edge type, so a reader can tell the two (``read_graph``).  Edge
    files are gzipped, as neighbouring lines of a closure differ little, and
    hold at most ``EDGES_PER_FILE`` edges, as such a file is read by one task.
    """
    if nodes.isEmpty():
        raise ValueError("no usable dependency record: the graph would be empty")
    (
        nodes.select(F.col("id").alias(NODE_HEADER[0]), F.lit(NODE_LABEL).alias(NODE_HEADER[1]))
        .orderBy(NODE_HEADER[0])
        .write.mode("overwrite")
        .csv(nodes_path, sep=GRAPH_DELIMITER, header=True)
    )
    typed = [
        pairs.select(
            F.col("src").alias(EDGE_HEADER[0]), F.col("dst").alias(EDGE_HEADER[1]), F.lit(kind).alias(EDGE_HEADER[2])
        )
        for pairs, kind in ((edges, DIRECT_EDGE_TYPE), (closure, TRANSITIVE_EDGE_TYPE))
        if pairs is not None
    ]
    (
        _union_all(typed)
        .write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", EDGES_PER_FILE)
        .csv(edges_path, sep=GRAPH_DELIMITER, header=True)
    )
