"""Exact top-k inner-product search with vector-approximation files.

A shard of the vectors keeps, beside the exact integers, an approximation: each
component's cell on a grid of ``2**BITS`` cells between the shard's smallest and
largest value of that dimension.  A block of queries first scans the cells: the
cells' edges give an upper and a lower bound of every score, and a vector whose
upper bound is below the k-th largest lower bound is out.  The rest are read
exactly, best bound first, until the k-th score found cannot be passed by any
bound still open.  Every shard's certain top k are then merged.

Queries meet shards block against block (an equi-join of block numbers); no
query set or shard is broadcast, and a task holds one block of each.

Defined results:

* component x counts as floor(scale * x); a vector that is null, empty or holds
  a null or non-finite component takes no part, nor does a row without an id.
* rows that share an id count as one vector, the smallest of theirs; a query
  never finds its own id.  Only vectors of the query's length are candidates.
* ties in score go to the smaller id; fewer candidates than k are all
  returned; an empty table gives no rows.
* scores beyond 64 bits are held at the limits of a long.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depuse.llm.staging import stage

SCALE = 256
BITS = 5
TOP = 5
SHARD_ROWS = 8192
QUERY_ROWS = 4096
SCAN_ROWS = 256  # queries whose bounds are held at once
READ_ROWS = 32  # exact vectors read at a time
RESULT = "query_id long, vec_id long, score long"


def integer_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, ints) of the rows that take part, one per id."""
    x = F.col(vector)
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    ints = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return (
        rows.filter(F.col(vec_id).isNotNull() & x.isNotNull() & (F.size(x) > 0)).filter(whole)
        .select(F.col(vec_id).cast("long").alias("vec_id"), ints.alias("ints"))
        .groupBy("vec_id").agg(F.min("ints").alias("ints"))
    )


class Cells:
    """Grid cells of a shard's vectors and the integers their edges allow."""

    def __init__(self, vectors: np.ndarray, bits: int = BITS):
        low, high = vectors.min(0), vectors.max(0)
        width = np.maximum(1, -((low - high - 1) >> bits))  # of a cell, rounded up
        self.cells = ((vectors - low) // width).astype(np.uint8 if bits <= 8 else np.uint32)
        self.low, self.width, self.high = low, width, high

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        lower = self.low + self.cells * self.width
        return lower, np.minimum(lower + self.width - 1, self.high)


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("ints").combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _exactly(queries: np.ndarray, vectors: np.ndarray) -> bool:
    """Whether all products and sums stay whole in a double."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1]
    return most < 2.0**52


def top_of_shard(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, top: int = TOP, bits: int = BITS,
    reads: Callable[[int], None] = lambda n: None,
) -> tuple[list[int], list[int], list[int]]:
    """(query id, vector id, score) of each query's best ``top`` in the shard.
    ``reads`` is told how many exact vectors each query read."""
    found: tuple[list[int], list[int], list[int]] = ([], [], [])
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    exact = _exactly(queries, vectors)
    kind = np.float64 if exact else object
    lower, upper = (e.astype(kind) for e in Cells(vectors, bits).edges()) if exact else (vectors.astype(object),) * 2
    whole = vectors.astype(kind)
    for begin in range(0, len(queries), SCAN_ROWS):
        block = queries[begin:begin + SCAN_ROWS].astype(kind)
        up, down = np.maximum(block, 0), np.minimum(block, 0)
        best = up @ upper.T + down @ lower.T
        worst = up @ lower.T + down @ upper.T
        for q, own, most, least in zip(block, query_ids[begin:begin + SCAN_ROWS], best, worst):
            other = ids != own
            k = min(top, int(other.sum()))
            if not k:
                continue
            floor = np.sort(least[other])[-k] if not exact else np.partition(least[other], -k)[-k]
            open_ = np.flatnonzero(other & (most >= floor))
            open_ = open_[np.argsort(-most[open_], kind="stable")]  # best bound first, then the smaller id
            scores, at = [], 0
            while at < len(open_):
                part = open_[at:at + READ_ROWS]
                # the k-th score so far cannot be reached by any bound still open
                if len(scores) >= k and scores[k - 1][0] > most[part[0]]:
                    break
                scores += zip((whole[part] @ q).tolist(), (-ids[part]).tolist())
                scores = sorted(scores, reverse=True)[:k]
                at += len(part)
            reads(at)
            found[0].extend([int(own)] * len(scores))
            found[1].extend(-i for _, i in scores)
            found[2].extend(max(-(2**63), min(2**63 - 1, int(s))) for s, _ in scores)
    return found


def search(
    vectors: DataFrame, is_query: Column, top: int = TOP, bits: int = BITS,
    shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score of the ``top`` best vectors for every
    vector that ``is_query`` names; ``vectors`` is (vec_id, ints)."""
    rows = stage(vectors.withColumns({"dim": F.size("ints"), "_query": F.coalesce(is_query, F.lit(False))}))
    counts = rows.agg(F.count(F.lit(1)), F.count_if("_query")).first()
    shards, blocks = max(1, -(-counts[0] // shard_rows)), max(1, -(-counts[1] // query_rows))

    def dealt(number: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(number)).cast("int")

    def every(number: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(number - 1)))

    candidates = rows.select("vec_id", "ints", "dim", dealt(shards).alias("shard"), every(blocks).alias("block"))
    asked = rows.filter("_query").select("vec_id", "ints", "dim", dealt(blocks).alias("block"), every(shards).alias("shard"))
    keys = ["shard", "block", "dim"]

    def meet(queries: pa.Table, shard: pa.Table) -> pa.Table:
        out = ([], [], [])
        if queries.num_rows and shard.num_rows:
            out = top_of_shard(
                queries.column("vec_id").to_numpy(), _matrix(queries), shard.column("vec_id").to_numpy(), _matrix(shard), top, bits
            )
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    best = asked.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(meet, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
