"""Which gavs of a session are dependencies of other gavs of the same session.

A gav of a session is a dependency when some gav of the same session reaches
it over one or more edges (intermediate nodes need not be in the session; a
gav on a cycle is its own dependency).  Set-based form:

    (c, s, gavs, g)  JOIN  (g -> targets)  ->  (c, s, targets that are in gavs)

The join is keyed by gav, so a gav present in a large share of the sessions
would be one hot partition: its rows are salted (``skew``).  The others meet the
targets where these lie.  What travels with a gav are 16-bit hashes of its
session's gavs, not their names; the targets that agree with one (others do by
chance in 1 of 65,536 comparisons) are then looked up in the session itself.

A session of more than ``PACKED_FROM`` gavs does not travel with each of its
gavs.  Its gavs are numbered and the targets of a gav become bitmaps of 32,768
numbers; those met by a session's gavs are or-ed, first within the map tasks,
and each of its gavs looks up its own bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depuse.functions.arrays import bit_is_set
from depuse.operators.graph import materialise, materialise_counted, packed_reach, reachable, traversal_pairs, unpacked
from depuse.operators.placed import staged
from depuse.operators.sessions import session_gavs
from depuse.operators.skew import DEFAULT_MIN_SHARE, hot_keys, salted_join

# Depth used when none is given (1: the whole closure), and the
# instrumentation columns' values for set-based computation (nothing is timed
# per session).
DEFAULT_DEPTH = 1
NOT_TIMED = -1
TARGETS_PER_ROW = 1000
PACKED_FROM = 64
FEW_NAMES = 10_000
SESSION = ["clientId", "sessionId"]


def session_dependencies(
    sessions: DataFrame,
    reach: DataFrame,
    salt: bool = True,
    packed_from: int = PACKED_FROM,
    present: DataFrame | None = None,
) -> DataFrame:
    """``clientId, sessionId, dependency`` (distinct) from sessions (with
    ``gavs``) and a reachability table ``src, dst`` or ``src, dsts``.

    Targets travel as arrays of at most about ``TARGETS_PER_ROW`` per row; of
    pairs, only targets that occur in some session are kept.  Whether a target is in the
    session is decided in the stage that joins, so only hits are shuffled.
    What a session of n gavs ships is n names and at most ``packed_from`` x n
    hashes; larger ones go by bitmaps (``_packed_dependencies``).  ``present`` is
    ``present_gavs`` of the sessions, if the caller has it.
    """
    present = present_gavs(sessions) if present is None else present
    reach = _from_present(present, reach)
    hot = _hot_gavs(present) if salt else None
    large = sessions.filter(F.size("gavs") > packed_from)
    if large.isEmpty():
        return _small_dependencies(sessions, reach, hot)
    small = _small_dependencies(sessions.filter(F.size("gavs") <= packed_from), reach, hot)
    return small.unionByName(_packed_dependencies(large, reach, hot))


def present_gavs(sessions: DataFrame) -> DataFrame:
    """``src, _n``: every gav of the sessions and how often it occurs."""
    return staged(sessions.select(F.explode("gavs").alias("src")).groupBy("src").agg(F.count(F.lit(1)).alias("_n")))


def _from_present(present: DataFrame, reach: DataFrame) -> DataFrame:
    """Reachability from the sessions' gavs, if these are few: it is filtered
    where it is read, so that the rest of a whole closure is not shuffled."""
    few = present.count() <= FEW_NAMES
    return reach.join(F.broadcast(present.select("src")), "src", "left_semi") if few else reach


def _hot_gavs(present: DataFrame) -> DataFrame | None:
    """Gavs with more than ``DEFAULT_MIN_SHARE`` of all (``skew.hot_keys``); None
    if there is none."""
    total = present.agg(F.sum("_n")).collect()[0][0] or 0
    often = present.filter(F.col("src").isNotNull() & (F.col("_n") > F.lit(total * DEFAULT_MIN_SHARE)))
    hot, names = materialise_counted(often.select("src"))
    return hot if names else None


def _looked_up(starts: DataFrame, targets: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``starts`` joined with ``targets`` on ``src``: hot ones salted, the others
    in the buckets of ``targets``, if it lies in some."""
    if hot is None:
        return starts.join(targets, "src")
    known = F.broadcast(hot)
    usual = starts.join(known, "src", "left_anti").join(targets, "src")
    common = salted_join(
        starts.join(known, "src", "left_semi"), targets.join(known, "src", "left_semi"), ["src"], hot=hot, hot_bounded=True
    )
    return usual.unionByName(common)


def _met(starts: DataFrame, targets: DataFrame, salt: bool) -> DataFrame:
    if not salt:
        return starts.join(targets, "src")
    return salted_join(starts, targets, ["src"], hot=hot_keys(starts.select("src"), ["src"]), hot_bounded=True)


def _small_dependencies(sessions: DataFrame, reach: DataFrame, hot: DataFrame | None) -> DataFrame:
    if "dsts" in reach.columns:
        targets = _target_rows(reach)
    else:
        present = sessions.select(F.explode("gavs").alias("dst")).distinct()
        useful = reach.select("src", "dst").join(present, "dst", "left_semi")
        sizes = useful.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / F.lit(TARGETS_PER_ROW)).alias("_rows"))
        targets = (
            useful.join(sizes, "src")
            .groupBy("src", F.pmod(F.xxhash64("dst"), F.col("_rows")).alias("_part"))
            .agg(F.collect_set("dst").alias("_targets")).drop("_part")
        )
    targets = targets.withColumn("_codes", F.transform("_targets", _code))
    starts = sessions.select(*SESSION, F.transform("gavs", _code).alias("_gavs"), F.explode("gavs").alias("src"))
    met = _looked_up(starts, targets, hot).filter(F.coalesce(F.arrays_overlap("_codes", "_gavs"), F.lit(False)))
    alike = met.select(*SESSION, F.explode(F.filter("_targets", lambda t: F.array_contains("_gavs", _code(t)))).alias("_found"))
    alike = alike.groupBy(*SESSION).agg(F.collect_set("_found").alias("_found"))
    alike = staged(alike).withColumnsRenamed({"clientId": "_client", "sessionId": "_session"})
    same = F.col("clientId").eqNullSafe(F.col("_client")) & F.col("sessionId").eqNullSafe(F.col("_session"))
    hits = sessions.select(*SESSION, "gavs").join(alike, same)
    return hits.select(*SESSION, F.explode(F.array_intersect("_found", "gavs")).alias("dependency")).distinct()


def _code(gav: Column) -> Column:
    """16 bits of a gav's hash."""
    return F.shiftright(F.hash(gav), 16).cast("smallint")


def _target_rows(reach: DataFrame) -> DataFrame:
    """Arrays of targets as they are, in slices of ``TARGETS_PER_ROW``."""
    slices = F.sequence(F.lit(1), F.size("dsts"), F.lit(TARGETS_PER_ROW))
    cut = reach.filter(F.size("dsts") > 0).select("src", "dsts", F.explode(slices).alias("_at"))
    return cut.select("src", F.slice("dsts", F.col("_at"), F.lit(TARGETS_PER_ROW)).alias("_targets"))


def _packed_dependencies(sessions: DataFrame, reach: DataFrame, hot: DataFrame | None) -> DataFrame:
    """The same by bitmaps: rows shuffled are linear in the sessions' gavs."""
    long = session_gavs(sessions).distinct()
    numbers = materialise(long.select("gav").distinct().withColumn("_n", F.monotonically_increasing_id()))
    block, bit = F.bitmap_bucket_number("_n").alias("_block"), F.bitmap_bit_position("_n").alias("_bit")
    members = long.join(numbers, "gav")
    if hot is not None:
        members = salted_join(long, numbers, ["gav"], hot=hot.withColumnRenamed("src", "gav"), hot_bounded=True)
    members = materialise(members.select(*SESSION, "gav", block, bit))
    useful = unpacked(reach).join(numbers.select(F.col("gav").alias("src")), "src", "left_semi")
    useful = useful.join(numbers.withColumnRenamed("gav", "dst"), "dst")
    targets = useful.groupBy("src", block).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_n")).alias("_bits"))
    met = _looked_up(members.select(*SESSION, F.col("gav").alias("src")), targets, hot)
    reached = met.groupBy(*SESSION, "_block").agg(F.bitmap_or_agg("_bits").alias("_bits"))
    hits = members.join(reached, [*SESSION, "_block"]).filter(bit_is_set(F.col("_bits"), F.col("_bit")))
    return hits.select(*SESSION, F.col("gav").alias("dependency"))


def session_traversal_work(
    sessions: DataFrame,
    edges: DataFrame,
    max_depth: int | None = None,
    mode: str = "auto",
    salt: bool = True,
    packed_from: int = PACKED_FROM,
) -> DataFrame:
    """``clientId, sessionId, n_paths, work`` of every session: number and
    summed length of the edge-simple paths from one of its gavs to one of its
    gavs (``traversal_pairs``; 0 where there is none).

    Sessions of up to ``packed_from`` gavs decide in the stage that joins
    whether an end is theirs; larger ones look ends up by a second join.
    """
    sessions = materialise(sessions)
    gavs = session_gavs(sessions).select(F.col("gav").alias("id")).distinct()
    pairs = materialise(traversal_pairs(edges, gavs, gavs, max_depth, mode).withColumnRenamed("seed", "src"))
    small, large = sessions.filter(F.size("gavs") <= packed_from), sessions.filter(F.size("gavs") > packed_from)
    ends = pairs.groupBy("src").agg(F.collect_list(F.struct("node", "n_paths", "work")).alias("_ends"))
    starts = small.select(*SESSION, F.array_distinct("gavs").alias("gavs"))
    met = _met(starts.select(*SESSION, "gavs", F.explode("gavs").alias("src")), ends, salt)
    inside = met.select(*SESSION, F.inline(F.filter("_ends", lambda e: F.array_contains("gavs", e["node"]))))
    long = session_gavs(large).distinct()
    apart = _met(long.withColumnRenamed("gav", "src"), pairs, salt)
    apart = apart.join(long.withColumnRenamed("gav", "node"), [*SESSION, "node"], "left_semi")
    every = inside.select(*SESSION, "n_paths", "work").unionByName(apart.select(*SESSION, "n_paths", "work"))
    none = sessions.select(*SESSION, F.lit(0).cast("bigint").alias("n_paths"), F.lit(0).cast("bigint").alias("work"))
    return every.unionByName(none).groupBy(*SESSION).agg(
        F.sum("n_paths").cast("bigint").alias("n_paths"), F.sum("work").cast("bigint").alias("work")
    )


def reach_for_depth(
    edges: DataFrame,
    depth: int,
    seeds: DataFrame | None = None,
    closure: DataFrame | None = None,
    salt: bool = False,
) -> DataFrame:
    """Reachability table for a depth setting: ``src, dst``, or ``src, dsts``
    (``graph.packed_reach``).

    ``1``: the precomputed closure (or, without one, unbounded reach from the
    seeds, which is the same relation); ``0``: unbounded; ``k >= 2``: within
    ``k`` hops.  Negative depths are rejected.
    """
    if depth < 0:
        raise ValueError("depth must be >= 0")
    if depth == 1:
        if closure is not None:
            return closure if "dsts" in closure.columns else closure.select("src", "dst")
        return packed_reach(edges, seeds=seeds, salt=salt)
    if depth == 0:
        return packed_reach(edges, seeds=seeds, salt=salt)
    return reachable(edges, seeds=seeds, max_depth=depth, salt=salt).select("src", "dst")


def enhance_sessions(sessions: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Sessions plus ``dependencies ARRAY<STRING>`` (sorted; empty, not null,
    for sessions without any), ``execMillis = -1`` and ``errorDeps = null``."""
    per_session = dependencies.groupBy("clientId", "sessionId").agg(
        F.array_sort(F.collect_list("dependency")).alias("dependencies")
    )
    empty = F.array().cast("array<string>")
    return (
        sessions.join(per_session, ["clientId", "sessionId"], "left")
        .withColumn("dependencies", F.coalesce(F.col("dependencies"), empty))
        .withColumn("execMillis", F.lit(NOT_TIMED).cast("bigint"))
        .withColumn("errorDeps", F.lit(None).cast("string"))
    )


def compute_dependencies(
    sessions: DataFrame,
    edges: DataFrame | None = None,
    depth: int = DEFAULT_DEPTH,
    closure: DataFrame | None = None,
    salt: bool = True,
    materialise_input: bool = True,
    salt_graph: bool = False,
) -> DataFrame:
    """Enhanced sessions for ``depth`` (see ``reach_for_depth``).

    Traversal starts only from gavs that occur in the given sessions.  The
    sessions are read by several branches (seeds, targets, hot keys, the join,
    the result); ``materialise_input`` writes them first so an expensive
    upstream plan runs once.  Pass False when ``sessions`` is a plain table
    scan.  ``salt`` spreads gavs of very many sessions, ``salt_graph`` nodes
    that very many others reach.
    """
    if edges is None and not (depth == 1 and closure is not None):
        raise ValueError("edges are required unless depth == 1 and a closure is given")
    if materialise_input:
        sessions = staged(sessions)
    present = present_gavs(sessions)
    reach = reach_for_depth(edges, depth, seeds=present.select(F.col("src").alias("id")), closure=closure, salt=salt_graph)
    return enhance_sessions(sessions, staged(session_dependencies(sessions, reach, salt=salt, present=present)))
