"""Sharding along a Hilbert curve, with DataFrame functions only.

Metadata dimensions are quantised to ``2**bits`` cells each, a cell's place on
the Hilbert curve is its sort key, and the sorted rows are cut into runs of
equal row counts (law ``rows``).  A shard is therefore a compact region of the
metadata space: a reader that wants one language, source or size class opens
only the shards whose cell ranges meet it (``shard_manifest``, ``prune``).

Defined results:

* law ``rows``: shard counts differ by at most one; with fewer rows than
  shards the rest stay empty.  ``slot`` counts 0, 1, ... within a shard.
* order: curve index, then a hash of the kept columns, then the kept columns;
  reruns agree.  Fully equal rows are interchangeable.
* null text: size 8, checksum of no bytes (0); a null category has cell 0;
  long texts are sized whole; an empty table gives no rows.
* only the columns in ``keep`` are carried, under their own names; they must
  be orderable.  Those the result adds (``shard``, ...) may not be kept.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depuse.llm.running import running_totals
from depuse.llm.staging import stage

BITS = 5
LAW = "rows"


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def crc_of(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def category_cell(value: Column, bits: int = BITS) -> Column:
    """A category's cell: its checksum modulo the cells; null is cell 0."""
    return F.coalesce(F.pmod(F.crc32(F.encode(value.cast("string"), "UTF-8")), F.lit(1 << bits)), F.lit(0)).cast("int")


def magnitude_cell(value: Column, bits: int = BITS) -> Column:
    """A size's cell: its number of binary digits; null or below 1 is cell 0."""
    digits = F.when(value >= 1, F.length(F.bin(value.cast("long")))).otherwise(0)
    return F.least(F.coalesce(digits, F.lit(0)), F.lit((1 << bits) - 1)).cast("int")


def curve_index(cells: Column, dims: int, bits: int = BITS) -> Column:
    """Place of a cell (array of ``dims`` ints below ``2**bits``) on the curve.

    Skilling's transform (AIP Conf. Proc. 707, 2004): undo the rotations from
    the highest bit down, Gray-encode, then interleave the bits.
    """
    if not 2 <= dims * bits <= 62 or dims < 2:
        raise ValueError("dims * bits must fit a long, dims at least 2")
    steps = F.array(*[
        F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(dims)
    ])

    def rotate(x: Column, step: Column) -> Column:
        low, first, other = step["q"] - 1, F.get(x, F.lit(0)), F.get(x, step["i"])
        flip = other.bitwiseAND(step["q"]) != 0
        swap = first.bitwiseXOR(other).bitwiseAND(low)
        return F.transform(x, lambda v, j: (
            F.when(j == 0, v.bitwiseXOR(F.when(flip, low).otherwise(swap)))
            .when((j == step["i"]) & ~flip, v.bitwiseXOR(swap)).otherwise(v)
        ))

    turned = F.aggregate(steps, cells, rotate) if bits > 1 else cells

    def gray(x: Column) -> Column:
        return F.transform(x, lambda v, j: F.aggregate(F.slice(x, 1, j + 1), F.lit(0), lambda a, b: a.bitwiseXOR(b)))

    def settle(x: Column) -> Column:
        last = F.get(x, F.lit(dims - 1))
        t = F.lit(0)
        for b in range(bits - 1, 0, -1):
            t = t.bitwiseXOR(F.when(last.bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
        return F.transform(x, lambda v: v.bitwiseXOR(t))

    places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(dims)])

    def interleave(x: Column) -> Column:
        return F.aggregate(places, F.lit(0).cast("long"), lambda h, p: (
            h * 2 + F.get(x, p["i"]).cast("long").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), p["b"])).__ne__(0).cast("long")
        ))

    return interleave(settle(gray(turned)))


def with_curve(cells: DataFrame, dims: Sequence[str], bits: int = BITS) -> DataFrame:
    """Add ``curve_index``; each transform is its own column, so that no
    expression is written out more than once."""
    return cells.withColumn("curve_index", curve_index(F.array(*dims), len(dims), bits))


def document_dims(docs: DataFrame) -> dict[str, Column]:
    """The production dimensions of ``documents``."""
    return {
        "lang_cell": category_cell(docs["lang"]),
        "source_cell": category_cell(docs["source"]),
        "size_cell": magnitude_cell(size_of(docs["text"])),
    }


def hilbert_shards(
    docs: DataFrame, shards: int, keep: Mapping[str, Column], dims: Mapping[str, Column] | None = None,
    bits: int = BITS,
) -> DataFrame:
    """``keep`` columns, the cells, ``curve_index``, ``law``, ``shard``, ``slot``.

    The cells (at most ``2**(bits * dims)``, 32,768 by default) are counted and
    ordered as a table of their own; only this bounded table is broadcast or
    seen by one task.  Rows of one cell, hot or not, are ranked in hash buckets.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    dims = document_dims(docs) if dims is None else dict(dims)
    rows = docs.select(*(c.alias(n) for n, c in keep.items()), *(c.alias(n) for n, c in dims.items()))
    rows = stage(rows.withColumns({"_key": F.xxhash64(*keep), "_one": F.lit(1).cast("long")}))
    counts = with_curve(rows.groupBy(*dims).agg(F.count(F.lit(1)).alias("_n")), list(dims), bits)
    upto = Window.orderBy("curve_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    cells = stage(counts.select(
        *dims, "curve_index", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("_all")
    ))
    placed = rows.join(F.broadcast(cells), list(dims))
    ranked = running_totals(placed, "curve_index", "_key", list(keep), "_one", "_rank")
    rank, total, n = F.col("_before") + F.col("_rank"), F.col("_all"), F.lit(shards)
    # rank r of N rows goes to shard floor(r * n / N); the shard begins at ceil(shard * N / n)
    shard = F.expr(f"(_before + _rank) * {shards} div _all")
    return (
        ranked.withColumn("_shard", shard)
        .withColumn("_first", F.expr(f"(_shard * _all + {shards - 1}) div {shards}"))
        .select(
            *keep, *dims, "curve_index", F.lit(LAW).alias("law"), F.col("_shard").cast("int").alias("shard"),
            (rank - F.col("_first")).cast("long").alias("slot"),
        )
    )


def write_shards(sharded: DataFrame, path: str, shards: int) -> None:
    """One folder per shard, rows in slot order: the files the readers prune."""
    sharded.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_manifest(sharded: DataFrame, dims: Sequence[str]) -> DataFrame:
    """One row per shard: its rows, and the cells it holds by dimension."""
    return sharded.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"), *(F.sort_array(F.collect_set(d)).alias(d) for d in dims)
    )


def prune(manifest: DataFrame, wanted: Mapping[str, int]) -> DataFrame:
    """Shards that may hold rows whose cells are the ``wanted`` ones."""
    out = manifest
    for dim, cell in wanted.items():
        out = out.filter(F.array_contains(dim, cell))
    return out.select("shard")
