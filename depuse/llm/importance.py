"""Target-distribution importance resampling with segment deduplication.

Hashed n-gram features of the raw corpus and of a target set give every bucket
a gain, floor(1000 * ln of the ratio of its two smoothed shares).  A document's
weight is the floored mean gain of its features; a Gumbel term drawn from its
id is added, and the highest scores are the draw (sampling without replacement
in proportion to exp(weight)).

The newline is a separator of words, so a text is cut into lines there.  Lines
repeat across a corpus (licences, navigation, copies): each distinct line's
features are hashed once, in a stage table; bucket counts are its features
times its occurrences, and a document's gain is the sum over its lines, met by
the line's digest.  n-grams that span lines belong to no line; they are counted
from the edges of a document's lines and added separately.

Only bucket counts (``buckets`` rows, a parameter) reach the driver.  Lines
that very many documents hold are salted in the join.  Ranks come from a range
partitioning of (score, id): every task numbers its own rows, so no task holds
more than one range.

Defined results:

* a null text has no features and weight 0; so has a text without words.
* a null id draws its term as the empty string; rows that repeat an id are
  rows of their own with the same term, each ranked.
* extra columns of the input take no part.  Empty tables give no rows; an empty
  target counts 0 everywhere.
* n-grams of a line longer than a task's memory are not split: one line must
  fit in a Python worker, a text need not.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depuse.llm.staging import stage
from depuse.operators.skew import salted_join

BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
RANGE_ROWS = 250_000  # rows a task numbers
HOT_SHARE = 0.01

# Every byte below 0x80 that is no letter or digit parts words; A-Z are folded.
_FOLD = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256)
)


def words_of(line: bytes) -> list[bytes]:
    """Folded words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 bytes."""
    return line.translate(_FOLD).split()


class Buckets(dict):
    """Bucket of a feature, remembered while the memo is small."""

    def __init__(self, buckets: int, most: int = 200_000):
        super().__init__()
        self.buckets, self.most = buckets, most

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[feature] = zlib.crc32(feature) % self.buckets
        return value

    def of(self, words: Sequence[bytes], max_n: int) -> list[int]:
        """Buckets of all runs of 1 to ``max_n`` words."""
        found = [self[w] for w in words]
        for n in range(2, max_n + 1):
            found += [self[b" ".join(words[i:i + n])] for i in range(len(words) - n + 1)]
        return found


def spanning(lines: Sequence[bytes], max_n: int) -> Iterator[list[bytes]]:
    """Runs of 2 to ``max_n`` words that touch more than one line."""
    edge = max_n - 1
    kept: list[tuple[bytes, int]] = []  # words that can take part, with a running line number
    block = 0  # words of different blocks are not next to each other
    blocks: list[int] = []
    for at, line in enumerate(lines):
        words = words_of(line)
        for k, w in enumerate(words):
            if k >= edge and k < len(words) - edge:
                continue
            if k == len(words) - edge and k > edge:
                block += 1
            kept.append((w, at))
            blocks.append(block)
    for n in range(2, max_n + 1):
        for i in range(len(kept) - n + 1):
            if blocks[i] == blocks[i + n - 1] and kept[i][1] != kept[i + n - 1][1]:
                yield [w for w, _ in kept[i:i + n]]


def _lists(values: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0] + [len(v) for v in values])
    flat = np.fromiter((x for v in values for x in v), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def line_features(texts: DataFrame, text: str, buckets: int, max_n: int) -> DataFrame:
    """Stage table (line_key, times, n_words, features): one row a distinct
    line that has words; ``features`` are the buckets of its n-grams."""
    lines = texts.select(F.explode(F.split(F.col(text), "\n")).alias("line"))
    distinct = lines.groupBy("line").agg(F.count(F.lit(1)).alias("times"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Buckets(buckets)
        for batch in batches:
            words = [words_of(line.encode()) for line in batch.column("line").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("line_key"), batch.column("times"), pa.array([len(w) for w in words], pa.int64()),
                 _lists([memo.of(w, max_n) for w in words])],
                names=["line_key", "times", "n_words", "features"],
            )

    keyed = distinct.filter("line <> ''").select(_digest(F.col("line")).alias("line_key"), "times", "line")
    return stage(
        keyed.mapInArrow(hashed, "line_key binary, times long, n_words long, features array<int>").filter("n_words > 0")
    )


def spanning_features(rows: DataFrame, text: str, buckets: int, max_n: int) -> DataFrame:
    """Stage table (uid, features): each text's n-grams that span lines."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [zlib.crc32(b" ".join(run)) % buckets for run in spanning(t.encode().split(b"\n"), max_n)]
                for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), _lists(found)], names=["uid", "features"])

    several = rows.filter(F.contains(F.col(text), F.lit("\n"))).select("uid", F.col(text).alias("text"))
    return stage(several.mapInArrow(hashed, "uid long, features array<int>").filter(F.size("features") > 0))


def _counts(lines: DataFrame, spans: DataFrame | None) -> DataFrame:
    """(bucket, n): occurrences of every bucket that occurs."""
    every = lines.select(F.explode("features").alias("bucket"), "times")
    if spans is not None:
        every = every.unionByName(spans.select(F.explode("features").alias("bucket"), F.lit(1).cast("long").alias("times")))
    return every.groupBy("bucket").agg(F.sum("times").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """Gain of every bucket from two tables (bucket, n); ``buckets`` numbers."""
    both = (
        raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
        .join(raw.select("bucket", F.col("n").alias("s")), "bucket", "left")
        .join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
        .na.fill(0, ["s", "t"])
    )
    table = np.zeros((buckets, 2))
    for r in both.collect():  # ``buckets`` rows
        table[r.bucket] = r.s, r.t
    s, t = table.T
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return [int(g) for g in np.floor(1000 * np.log(ratio))]


def _gained(lines: DataFrame, key: str, gain: list[int]) -> DataFrame:
    """(key, n_words, n_features, gain) of rows with ``features``."""
    table = np.array(gain, np.int64)
    has_words = "n_words" in lines.columns

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("features")
            flat = table[lists.flatten().to_numpy(zero_copy_only=False)]
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            total = np.concatenate([[0], np.cumsum(flat)])
            words = batch.column("n_words") if has_words else pa.array(np.zeros(len(lists), np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), words, pa.array(np.diff(ends).astype(np.int64)), pa.array(total[ends[1:]] - total[ends[:-1]])],
                names=[key, "n_words", "n_features", "gain"],
            )

    kind = dict(lines.dtypes)[key]
    columns = [key, "features"] + ["n_words"] * has_words
    return lines.select(*columns).mapInArrow(summed, f"{key} {kind}, n_words long, n_features long, gain long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of a digest."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, first: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(uid, rank) of the ``first`` rows by score descending, doc_id, uid."""
    order = [F.desc("score"), F.asc("doc_id"), F.asc("uid")]
    n = rows.count()
    parts = max(1, -(-n // range_rows))
    dealt = stage(
        rows.select("uid", "doc_id", "score").repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    )
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")).filter(F.col("offset") < first)
    within = Window.partitionBy("part").orderBy(*order)
    return (
        dealt.join(offsets, "part").withColumn("rank", F.col("offset") + F.row_number().over(within))
        .filter(F.col("rank") <= first).select("uid", "rank")
    )


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
    buckets: int = BUCKETS, max_n: int = 1, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document.

    ``percent`` of the documents with ``min_words`` words or more are drawn
    (rounded down): those of the highest scores, ``rank`` 1, 2, 3 ...; the rank
    of the others is null.
    """
    if max_n < 1 or buckets < 1 or not 0 <= percent <= 100:
        raise ValueError("max_n and buckets must be >= 1, percent 0 to 100")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    aim = target.select(F.col(f"`{target_text}`").alias("text"))
    raw_lines = line_features(rows, "text", buckets, max_n)
    aim_lines = line_features(aim, "text", buckets, max_n)
    raw_spans = aim_spans = None
    if max_n > 1:
        rows = stage(rows.withColumn("uid", F.monotonically_increasing_id()))  # one id for two readings
        raw_spans = spanning_features(rows, "text", buckets, max_n)
        aim_spans = spanning_features(aim.withColumn("uid", F.monotonically_increasing_id()), "text", buckets, max_n)
    else:
        rows = rows.withColumn("uid", F.monotonically_increasing_id())
    gain = gains(_counts(raw_lines, raw_spans), _counts(aim_lines, aim_spans), buckets)

    held = rows.select("uid", "doc_id", F.explode_outer(F.split("text", "\n")).alias("line"))
    held = held.select("uid", "doc_id", _digest(F.col("line")).alias("line_key"))
    total = raw_lines.agg(F.sum("times").alias("t")).select((F.col("t") * F.lit(HOT_SHARE)).alias("t")).scalar()
    hot = raw_lines.filter(F.col("times") > total).select("line_key")  # at most 1 / HOT_SHARE
    met = salted_join(held, _gained(raw_lines, "line_key", gain), ["line_key"], "left", min_share=HOT_SHARE, hot=hot, hot_bounded=True)
    parts = met.select("uid", "doc_id", "n_words", "n_features", "gain")
    if raw_spans is not None:
        spans = _gained(raw_spans, "uid", gain).join(rows.select("uid", "doc_id"), "uid")
        parts = parts.unionByName(spans.select(*parts.columns))
    sums = parts.groupBy("uid", "doc_id").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "n_features", "gain")]
    )
    mean = F.expr("case when n_features = 0 then 0L else (gain - pmod(gain, n_features)) div n_features end")
    scored = stage(
        sums.withColumn("weight", mean).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).drop("gain")
    )
    pool = scored.filter(F.col("n_words") >= min_words)
    ranks = ranked(pool, percent * pool.count() // 100, range_rows)
    return scored.join(ranks, "uid", "left").select(
        "doc_id", "n_words", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank")
    )
