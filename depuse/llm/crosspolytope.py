"""Approximate nearest neighbours (largest inner product) by cross-polytope hashing.

Hash: a vector's direction is turned by a pseudo-rotation (three rounds of
random signs and a fast Hadamard transform) and assigned to the nearest signed
axis, the vertex of the cross-polytope closest to it.  ``tables`` independent
hashes, each of one or more concatenated axes as the number of vectors asks
for, index every vector.  A query probes its best vertices in every table in
order of closeness (multiprobe); the vectors found are reranked by their exact
inner products.

How many probes a query needs follows from what it has found.  With ``s`` its
k-th best score so far, a missed neighbour has a cosine of at least
``s / (|query| * largest norm)``; how often two directions of that cosine meet
within p probes of the tables is known from a simulation of the hash.  A query
whose chance is ``RECALL`` or more is done; the others go on to the next,
larger number of probes.  What is still open after that (directions without
near neighbours) is compared with everything, exactly.

Vectors are hashed per shell of norms (a factor of two wide), because within a
shell a large inner product means a small angle; a shell whose largest norm
cannot reach ``s`` is left out.  Exact copies count as one class: it is hashed
and compared once and stands for its smallest ids.

Queries meet buckets block against block: a bucket is cut into blocks of at
most ``BLOCK_ROWS`` vectors, and its queries likewise, so a bucket of any size
is compared whole without one task holding it.  Neither pairs nor candidates
are ever listed; a task keeps the best of its block.

Defined results:

* a vector that is null, empty, all zero or holds a null or non-finite
  component takes no part, nor does a row without an id; rows that share an id
  count as one vector, the smallest of theirs; only vectors of the query's
  length are its candidates.
* a query never finds its own id; ties in score go to the smaller id; if there
  are fewer than k candidates all are returned; an empty table gives no rows.
* scores are sums of products in double precision in one fixed order, so equal
  pairs have equal scores in any block.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depuse.llm.staging import stage
from depuse.operators.skew import salted_join
from depuse.operators.topn import top_rows

TOP = 20
TABLES = 4
PROBES = (4, 16)
RECALL = 0.97
BUCKET_ROWS = 256  # vectors a bucket is meant to hold
BLOCK_ROWS = 8192
QUERY_ROWS = 2048
SCAN_ROWS = 256
SEED = 11
HOT_SHARE = 0.01
MOST_SHELLS = 10_000  # shells broadcast to the queries; more are joined
SAMPLES = 1000


# -- the hash -----------------------------------------------------------------


def width_of(dim: int) -> int:
    """Length of the Hadamard transform: the next power of two."""
    return 1 << max(0, dim - 1).bit_length()


def axes_for(n: int, dim: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Concatenated axes, so that ``n`` vectors fill their buckets."""
    return max(1, int(math.log(max(1, n / bucket_rows)) / math.log(2 * width_of(dim))))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row, scaled to keep lengths."""
    n, width = x.shape
    step = 1
    while step < width:
        pairs = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, width)
        step *= 2
    return x / math.sqrt(width)


@functools.lru_cache(maxsize=256)
def _signs(seed: int, table: int, axis: int, width: int) -> np.ndarray:
    return np.random.default_rng([seed, table, axis, width]).choice([-1.0, 1.0], (3, width))


def turned(directions: np.ndarray, table: int, axis: int, seed: int = SEED) -> np.ndarray:
    """Pseudo-rotation number (table, axis) of unit vectors, padded."""
    width = width_of(directions.shape[1])
    x = np.zeros((len(directions), width))
    x[:, : directions.shape[1]] = directions
    for signs in _signs(seed, table, axis, width):
        x = hadamard(x * signs)
    return x


def _closeness(x: np.ndarray) -> np.ndarray:
    """Closeness of every signed axis: + axes, then - axes."""
    return np.concatenate([x, -x], 1)


def codes(directions: np.ndarray, table: int, axes: int, seed: int = SEED) -> np.ndarray:
    """Bucket of every direction: its nearest signed axes as one number."""
    code = np.zeros(len(directions), np.int64)
    for axis in range(axes):
        near = _closeness(turned(directions, table, axis, seed))
        code = code * near.shape[1] + near.argmax(1)
    return code


def _probe_order(closeness: list[np.ndarray], probes: int) -> np.ndarray:
    """For one query: its best ``probes`` buckets, nearest first.  A bucket's
    distance is the sum over its axes of squared shortfalls."""
    best, distance = np.zeros(1, np.int64), np.zeros(1)
    for near in closeness:
        take = min(probes, len(near))
        first = np.argpartition(-near, take - 1)[:take]
        gap = (near.max() - near[first]) ** 2
        total = (distance[:, None] + gap[None, :]).ravel()
        code = (best[:, None] * len(near) + first[None, :]).ravel()
        order = np.lexsort((code, total))[:probes]
        best, distance = code[order], total[order]
    return best


def probe_codes(directions: np.ndarray, table: int, axes: int, probes: int, seed: int = SEED) -> list[np.ndarray]:
    near = [_closeness(turned(directions, table, axis, seed)) for axis in range(axes)]
    return [_probe_order([n[i] for n in near], probes) for i in range(len(directions))]


@functools.lru_cache(maxsize=64)
def _meeting(width: int, axes: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid of cosines and how often directions of that cosine meet within
    ``probes`` probes of one table: a simulation with even random rotations."""
    grid = np.linspace(0, 1, 41)
    draw = np.random.default_rng([width, axes, probes])
    n = min(SAMPLES, max(200, 2_000_000 // (width * axes)))
    met = np.zeros(len(grid))
    for _ in range(n):
        q = draw.normal(size=(axes, width))
        u = draw.normal(size=(axes, width))
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        u -= (u * q).sum(1, keepdims=True) * q
        u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
        probed = _probe_order(list(_closeness(q)), probes)
        x = grid[:, None, None] * q + np.sqrt(1 - grid**2)[:, None, None] * u
        nearest = np.concatenate([x, -x], 2).argmax(2)
        code = np.zeros(len(grid), np.int64)
        for axis in range(axes):
            code = code * 2 * width + nearest[:, axis]
        met += np.isin(code, probed)
    return grid, np.maximum.accumulate(met / n)


def chance(cosine: float, dim: int, axes: int, tables: int, probes: int) -> float:
    """Chance that a neighbour of ``cosine`` meets the query in some table."""
    grid, met = _meeting(width_of(dim), axes, probes)
    at = met[max(0, int(np.searchsorted(grid, cosine + 1e-9, "right")) - 1)]
    return 1 - (1 - float(at)) ** tables if cosine >= 0 else 0.0


def _directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and norms; scaled first, so that squares stay finite."""
    most = np.abs(vectors).max(1, keepdims=True)
    scaled = vectors / most
    length = np.linalg.norm(scaled, axis=1, keepdims=True)
    return scaled / length, (length * most)[:, 0]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _by_dim(dims: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for dim in np.unique(dims):
        yield int(dim), np.flatnonzero(dims == dim)


# -- reranking a block ----------------------------------------------------------


def best_of_block(
    asked: np.ndarray, floors: np.ndarray, ids: np.ndarray, vectors: np.ndarray, top: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query its number, and the places and scores of its ``top`` best
    vectors (ties to the smaller id) that reach its floor (nan: none)."""
    order = np.argsort(ids, kind="stable")
    vectors = vectors[order]
    for begin in range(0, len(asked), SCAN_ROWS):
        block = asked[begin:begin + SCAN_ROWS]
        for i, near in enumerate(block @ vectors.T):
            least = -np.inf if len(near) <= top else np.partition(near, len(near) - top)[len(near) - top]
            if not math.isnan(floors[begin + i]):
                least = max(least, floors[begin + i])
            # the product's order of sums is its own: a little more is taken, then summed anew
            slack = 1e-9 * float(np.abs(block[i]).sum() * np.abs(vectors).max(initial=0))
            open_ = np.flatnonzero(near >= least - slack)
            scores = (vectors[open_] * block[i]).sum(1)
            first = np.lexsort((open_, -scores))[:top]
            yield begin + i, order[open_[first]], scores[first]


# -- on Spark ---------------------------------------------------------------------

KEY = ["dim", "shell", "tbl", "bucket"]


def classes_of(rows: DataFrame, vec_id: str, vector: str, top: int) -> tuple[DataFrame, DataFrame]:
    """Stage tables: (vec_id, twin, v) of every vector that takes part, and
    (twin, ids): the ``top`` + 1 smallest ids of each class of equal vectors."""
    x = F.col(f"`{vector}`")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    taken = rows.filter(F.col(f"`{vec_id}`").isNotNull() & x.isNotNull() & whole & F.exists(x, lambda v: v != 0))
    one = taken.groupBy(F.col(f"`{vec_id}`").cast("long").alias("vec_id")).agg(F.min(x).alias("v"))
    one = stage(one.withColumn("twin", F.unhex(F.md5(F.col("v").cast("string").cast("binary")))))
    firsts = top_rows(one.select("vec_id", "twin"), ["twin"], [F.asc("vec_id")], top + 1, ["vec_id"])
    return one, stage(firsts.groupBy("twin").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))


def build_index(one: DataFrame, classes: DataFrame, tables: int, bucket_rows: int, seed: int) -> DataFrame:
    """Stage table of one row a class: rep, ids, v, dim, norm, shell, buckets."""
    n = classes.count()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array([len(v) for v in batch.column("v")])
            norms = np.zeros(len(dims))
            found = np.zeros((len(dims), tables), np.int64)
            for dim, at in _by_dim(dims):
                directions, norms[at] = _directions(_matrix(batch.column("v").take(pa.array(at))))
                for t in range(tables):
                    found[at, t] = codes(directions, t, axes_for(n, dim, bucket_rows), seed)
            shells = np.rint(np.log2(norms)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(dims, pa.int32()), pa.array(norms), pa.array(shells),
                 pa.array(found.tolist(), pa.list_(pa.int64()))],
                names=[*batch.schema.names, "dim", "norm", "shell", "buckets"],
            )

    reps = one.select("vec_id", "v").join(classes.select(F.col("ids")[0].alias("vec_id"), "ids"), "vec_id")
    kind = dict(one.dtypes)["v"]
    return stage(
        reps.select(F.col("vec_id").alias("rep"), "ids", "v").mapInArrow(
            hashed, f"rep long, ids array<long>, v {kind}, dim int, norm double, shell int, buckets array<long>"
        )
    )


def _blocks(count: Column, rows: int) -> Column:
    return F.ceil(count / F.lit(rows)).cast("int")


def _dealt(count: Column, key: str) -> Column:
    return F.pmod(F.xxhash64(key), count).cast("int")


def _every(count: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), count - 1))


def compare(asked: DataFrame, index: DataFrame, key: list[str], top: int, block_rows: int, query_rows: int) -> DataFrame:
    """(query, rep, size, score): the best of every block for its queries.

    ``asked`` is (query, v, least, *key), ``index`` (rep, size, v, *key); rows
    meet where the key agrees.
    """
    there = index.groupBy(*key).agg(_blocks(F.count(F.lit(1)), block_rows).alias("blocks"))
    wanted = asked.groupBy(*key).agg(_blocks(F.count(F.lit(1)), query_rows).alias("q_blocks"))
    meeting = stage(there.join(wanted, key))
    left = salted_join(asked, meeting, key)
    left = left.withColumns({"q_block": _dealt(F.col("q_blocks"), "query"), "block": _every(F.col("blocks"))})
    right = salted_join(index, meeting, key)
    right = right.withColumns({"block": _dealt(F.col("blocks"), "rep"), "q_block": _every(F.col("q_blocks"))})
    meet = [*key, "block", "q_block"]

    def rerank(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = ([], [], [], [])
        if queries.num_rows and vectors.num_rows:
            ids, sizes = (vectors.column(c).to_numpy() for c in ("rep", "size"))
            names, floors = (queries.column(c).to_numpy() for c in ("query", "least"))
            for i, at, scores in best_of_block(_matrix(queries.column("v")), floors, ids, _matrix(vectors.column("v")), top + 1):
                out[0].append(np.full(len(at), names[i]))
                for column, values in zip(out[1:], (ids[at], sizes[at], scores)):
                    column.append(values)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table(
            [pa.array(np.concatenate(c) if c else [], k) for c, k in zip(out, kinds)], names=["query", "rep", "size", "score"]
        )

    left = left.select("query", "v", F.coalesce("least", F.lit(float("nan"))).alias("least"), *meet)
    right = right.select("rep", "size", "v", *meet)
    return left.groupBy(*meet).cogroup(right.groupBy(*meet)).applyInArrow(rerank, "query long, rep long, size long, score double")


def _best(found: DataFrame, top: int) -> DataFrame:
    """The classes that hold each query's ``top`` + 1 best ids, and ``least``:
    the score of the last of them, null while there are not so many."""
    one = found.groupBy("query", "rep").agg(F.max("size").alias("size"), F.max("score").alias("score"))
    before = Window.partitionBy("query").orderBy(F.desc("score"), "rep").rowsBetween(Window.unboundedPreceding, -1)
    kept = one.withColumn("_before", F.coalesce(F.sum("size").over(before), F.lit(0))).filter(F.col("_before") <= top)
    whole = Window.partitionBy("query")
    least = F.when(F.sum("size").over(whole) > top, F.min("score").over(whole))
    return kept.withColumn("least", least).drop("_before")


def _probes(open_: DataFrame, n: int, tables: int, first: int, last: int, bucket_rows: int, seed: int) -> DataFrame:
    """(query, v, least, *KEY): probes ``first`` to ``last`` - 1 of every table."""
    kind = dict(open_.dtypes)["v"]

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim, at in _by_dim(dims):
                directions, _ = _directions(_matrix(batch.column("v").take(pa.array(at))))
                for t in range(tables):
                    each = [c[first:] for c in probe_codes(directions, t, axes_for(n, dim, bucket_rows), last, seed)]
                    row = np.repeat(at, [len(c) for c in each])
                    if not len(row):
                        continue
                    kept = pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [*kept.columns, pa.array(np.full(len(row), t), pa.int32()), pa.array(np.concatenate(each))],
                        names=[*batch.schema.names, "tbl", "bucket"],
                    )

    columns = open_.select("query", "v", "least", "dim", "shell")
    return columns.mapInArrow(
        probed, f"query long, v {kind}, least double, dim int, shell int, tbl int, bucket long"
    )


def _still_open(asked: DataFrame, best: DataFrame, n: int, tables: int, probes: int, bucket_rows: int, recall: float) -> DataFrame:
    """The (query, shell) rows whose neighbours may well have been missed."""
    now = asked.drop("least").join(best.select("query", "least").distinct(), "query", "left")

    def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("least", "norm", "most", "dim")))
            keep = []
            for least, norm, most, dim in rows:
                if least is None:
                    keep.append(True)
                elif least > norm * most * (1 + 1e-9):
                    keep.append(False)  # no vector of the shell reaches it
                else:
                    keep.append(chance(least / (norm * most), dim, axes_for(n, dim, bucket_rows), tables, probes) < recall)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return stage(now.mapInArrow(sure, now.schema))


def search(
    rows: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", top: int = TOP,
    tables: int = TABLES, probes: tuple[int, ...] = PROBES, recall: float = RECALL, bucket_rows: int = BUCKET_ROWS,
    block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, seed: int = SEED,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found for every row
    that ``is_query`` (an expression of the id column) names."""
    if top < 1 or tables < 1 or not probes or list(probes) != sorted(set(probes)) or probes[0] < 1:
        raise ValueError("top and tables must be >= 1, probes increasing")
    one, classes = classes_of(rows, vec_id, vector, top)
    index = build_index(one, classes, tables, bucket_rows, seed)
    n = index.count()
    queries = one.select(F.col("vec_id").alias(vec_id), "twin").filter(F.coalesce(is_query, F.lit(False)))
    twins = classes.select("twin", F.col("ids")[0].alias("query"))
    members = stage(salted_join(queries.withColumnRenamed(vec_id, "query_id"), twins, ["twin"]).drop("twin"))

    shells = stage(index.groupBy("dim", "shell").agg(F.max("norm").alias("most")))
    asked = index.select(F.col("rep").alias("query"), "v", "dim", "norm").join(members.select("query").distinct(), "query")
    shells = F.broadcast(shells) if shells.count() <= MOST_SHELLS else shells
    asked = stage(asked.join(shells, "dim").withColumn("least", F.lit(None).cast("double")))

    vectors = index.select("rep", F.size("ids").cast("long").alias("size"), "v", "dim", "shell", "buckets")
    placed = vectors.select("rep", "size", "v", "dim", "shell", F.posexplode("buckets").alias("tbl", "bucket"))
    best = None
    done = 0
    for last in probes:
        probed = stage(_probes(asked, n, tables, done, last, bucket_rows, seed))
        found = compare(probed, placed, KEY, top, block_rows, query_rows)
        if best is not None:
            found = found.unionByName(best.drop("least"))
        best = stage(_best(found, top))
        asked = _still_open(asked, best, n, tables, last, bucket_rows, recall)
        done = last
    rest = compare(asked.select("query", "v", "least", "dim", "shell"), vectors.drop("buckets"), ["dim", "shell"], top, block_rows, query_rows)
    best = _best(rest.unionByName(best.drop("least")), top)

    ids = index.select("rep", "ids")
    near = best.select("query", "rep", "score").join(ids, "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    order = F.struct((-F.col("score")).alias("far"), "vec_id")
    packed = near.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(order)), 1, top + 1).alias("near"))
    given = salted_join(members, packed, ["query"])
    others = F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))
    each = given.select("query_id", F.posexplode(F.slice(others, 1, top)).alias("at", "near"))
    return each.select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("near.vec_id").alias("vec_id"), (-F.col("near.far")).alias("score")
    )
