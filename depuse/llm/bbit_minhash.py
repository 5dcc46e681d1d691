"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

A document's set holds its distinct 5-word shingles (A-Z lower-cased; with
fewer words, the whole sequence is the one shingle).  Of ``BANDS * ROWS``
minima only the low ``BITS`` bits are kept; the bytes of a band, packed into one
long, are also its bucket.  Documents that meet in a bucket are candidates;
their similarity is estimated from the equal bytes of the packed signatures,
corrected for the ``2**-BITS`` of bytes that agree by chance; what the estimate
leaves is confirmed on the full sets (100 * intersection >= 75 * union).

Work per group of copies is not its square:

* equal word sequences become one node before any bucket is made;
* in a bucket every member is first compared with one hub, the smallest, and
  confirmed pairs make components;
* what is left are buckets that hold several components.  There the members
  outside the bucket's largest component are compared with those of other
  components: pair by pair in small buckets, and block against block in large
  ones, where signatures and sets are compared inside the task and only links
  that join components leave it.  No candidate is lost, and pairs inside a
  component are never formed.

At similarity 0.75, 48 bands of 5 rows miss 2 pairs in a million; the estimate
(240 bytes, standard error 0.028) is cut 4.6 standard errors below.

Defined results: null or empty texts have an empty set (n_shingles 0), link
with nothing and are kept.  A null id links with nothing: component null, kept.
A row belongs to the component of its text, so copies and repeated rows share
one; a repeated row of the smallest id is kept each time.  Texts whose smallest
id is the same count as linked.  Whole texts are read, however long.  An empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depuse.llm.components import components
from depuse.llm.staging import small_batches, stage
from depuse.llm.words import WordHashes, mixed, words_of
from depuse.operators.skew import hot_keys, salted_join
from depuse.operators.topn import free_name

SHINGLE = 5
PERCENT = 75
BANDS, ROWS, BITS = 48, 5, 8
LEAST_ESTIMATE = 0.62
# Buckets up to this many members are paired in a join, larger ones are
# compared in blocks.
SMALL_BUCKET = 16
BLOCK_ROWS = 1000
# Ids up to this many (8 bytes each) are broadcast, more are shuffled.
BROADCAST_IDS = 1_000_000
CHUNK_WORDS = 100_000

SKETCH = "doc_id long, text_hash long, low long, high long, n_shingles long, signature array<long>"
SETS = "node long, shingles array<long>"

_rng = np.random.default_rng(10)
_FACTORS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` words."""
    n = len(hashes) - width + 1
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * _BASE + hashes[j:j + n]
    return mixed(out + np.uint64(width))


def shingle_set(words: list[bytes], memo: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of lower-cased words."""
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(_rolled(memo.of(words), min(SHINGLE, len(words))))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Packed signatures (one long per band) of non-empty sets."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.zeros((len(sets), BANDS), np.int64)
    low = np.uint32((1 << BITS) - 1)
    for k in range(BANDS * ROWS):
        minima = np.minimum.reduceat(x * _FACTORS[k] + _SHIFTS[k], starts)
        out[:, k // ROWS] |= (minima & low).astype(np.int64) << (BITS * (k % ROWS))
    return out


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64, copy=False)))


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Row ranges of about ``CHUNK_WORDS`` words, with their words."""
    begin, words, count = 0, [], 0
    for at, text in enumerate(batch.column("text")):
        words.append([w for w in words_of(text.as_py())])
        count += len(words[-1])
        if count >= CHUNK_WORDS or at == batch.num_rows - 1:
            yield batch.slice(begin, at + 1 - begin), words
            begin, words, count = at + 1, [], 0


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = WordHashes()
    for batch in batches:
        for rows, texts in _chunks(batch):
            texts = [[w.lower() for w in words] for words in texts]
            sets = [shingle_set(words, memo) for words in texts]
            digests = [xxhash.xxh3_128_intdigest(b" ".join(words)) for words in texts]
            some = [k for k, s in enumerate(sets) if len(s)]
            signed: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sets)
            if some:
                for k, signature in zip(some, signatures([sets[k] for k in some])):
                    signed[k] = signature
            halves = np.array([[d & (2**64 - 1), d >> 64] for d in digests], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("text_hash"), pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                 pa.array([len(s) for s in sets], pa.int64()), _lists(signed)],
                ["doc_id", "text_hash", "low", "high", "n_shingles", "signature"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = WordHashes()
    for batch in batches:
        for rows, texts in _chunks(batch):
            sets = [shingle_set([w.lower() for w in words], memo).view(np.int64) for words in texts]
            yield pa.RecordBatch.from_arrays([rows.column("node"), _lists(sets)], ["node", "shingles"])


def sketch(docs: DataFrame) -> DataFrame:
    """Ids, digests, set sizes and packed signatures of ``docs``."""
    small_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(_sketch, SKETCH)


def estimate(left: Column, right: Column) -> Column:
    """Similarity from packed signatures: the share of equal bytes, less what
    agrees by chance.  A byte of the xor is folded to one bit and counted."""
    low_bits = sum(1 << (BITS * r) for r in range(ROWS))

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for shift in (4, 2, 1):
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
        return F.bit_count(d.bitwiseAND(F.lit(low_bits)))

    unlike = F.aggregate(F.zip_with(left, right, differing), F.lit(0), lambda a, n: a + n)
    chance = 2.0**-BITS
    return (1 - unlike / F.lit(BANDS * ROWS) - F.lit(chance)) / F.lit(1 - chance)


def _few(ids: DataFrame) -> DataFrame:
    """``ids``, marked for broadcast when their counted number is bounded."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose estimate leaves room for the similarity.  ``a``
    may be a hub of very many pairs; its rows are salted."""
    signed = nodes.select("node", "signature")
    left = signed.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    right = signed.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
    met = salted_join(pairs.join(right, "b"), left, ["a"], hot=hot_keys(pairs, ["a"]), hot_bounded=True)
    return met.filter(estimate(F.col("sa"), F.col("sb")) >= LEAST_ESTIMATE).select("a", "b").distinct()


def shingle_sets(ids: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes in ``ids``, from their whole texts."""
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(_few(ids), "node", "left_semi")
    wanted = nodes.select("node", F.col("text_hash").alias("_wanted")).join(ids, "node", "left_semi")
    return stage(
        texts.withColumn("_hash", F.xxhash64("text")).join(_few(wanted), "node")
        .filter(F.col("_hash") == F.col("_wanted")).select("node", "text").mapInArrow(_sets, SETS)
        .dropDuplicates(["node", "shingles"])
    )


def confirmed(near: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    ids = stage(near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct())
    sets = shingle_sets(ids, nodes, docs)
    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = salted_join(near.join(second, "b"), first, ["a"], hot=hot_keys(near, ["a"]), hot_bounded=True)
    common = F.size(F.array_intersect("sa", "sb"))
    return (
        both.withColumn("_common", common)
        .filter(100 * F.col("_common") >= PERCENT * (F.size("sa") + F.size("sb") - F.col("_common")))
        .select("a", "b").distinct()
    )


def _hub_pairs(members: DataFrame) -> DataFrame:
    """(hub, other) of every bucket; the hub is its smallest node."""
    hubs = members.groupBy("bucket").agg(F.min("node").alias("a"))
    return members.join(hubs, "bucket").filter("node <> a").select("a", F.col("node").alias("b")).distinct()


def _apart(members: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Members (bucket, node, component) of the buckets that hold more than
    one component, with the bucket's ``main`` component (the largest) and how
    many members it has in all and outside that one."""
    if groups is None:
        placed = members.withColumn("component", F.col("node"))
    else:
        placed = members.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    buckets = sizes.groupBy("bucket").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("members"),
        (F.sum("n") - F.max("n")).alias("others"),
    )
    return placed.join(buckets.filter("others > 0"), "bucket")


def _small_bucket_pairs(apart: DataFrame) -> DataFrame:
    """Pairs of different components that share a bucket of few members."""
    few = apart.filter(F.col("members") <= SMALL_BUCKET)
    other = few.select("bucket", F.col("node").alias("b"), F.col("component").alias("_other"))
    return (
        few.select("bucket", F.col("node").alias("a"), "component").join(other, "bucket")
        .filter("a < b and component <> _other").select("a", "b").distinct()
    )


def _list_column(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    column = table.column(name).combine_chunks()
    return column.flatten().to_numpy(), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))


class _Block:
    """Nodes, components, packed signatures and sets of one side of a block."""

    def __init__(self, table: pa.Table):
        self.node, self.component = (table.column(c).to_numpy() for c in ("node", "component"))
        self.bands = _list_column(table, "signature")[0].reshape(-1, BANDS)
        self.bytes = np.ascontiguousarray(self.bands).view(np.uint8).reshape(-1, BANDS, 8)[:, :, :ROWS].reshape(table.num_rows, -1)
        self.shingles, self.ends = _list_column(table, "shingles")

    def set_of(self, k: int) -> np.ndarray:
        return self.shingles[self.ends[k]:self.ends[k + 1]]


def _common(own: np.ndarray, block: _Block, rows: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of a sorted set with those of ``rows``."""
    sets = [block.set_of(k) for k in rows]
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    return np.add.reduceat((own[at] == flat).astype(np.int64), np.concatenate(([0], np.cumsum([len(x) for x in sets])[:-1])))


def _links_in_blocks(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Confirmed links between a bucket's outsiders and its members, no more
    than join their components.  A pair is looked at in the first band that it
    shares, and only if its estimate leaves room for the similarity."""
    found: list[tuple[int, int]] = []
    if left.num_rows and right.num_rows:
        out, all_ = _Block(left), _Block(right)
        band = key[0].as_py() >> (BITS * ROWS)
        least = (LEAST_ESTIMATE * (1 - 2.0**-BITS) + 2.0**-BITS) * BANDS * ROWS
        top: dict[int, int] = {}

        def root(c: int) -> int:
            while c in top:
                c = top[c]
            return c

        for k in range(left.num_rows):
            apart = all_.component != out.component[k]
            apart &= (all_.bytes == out.bytes[k]).sum(1) >= least
            apart &= ~(all_.bands[:, :band] == out.bands[k, :band]).any(1)
            rows = np.flatnonzero(apart)
            if not len(rows):
                continue
            own = np.sort(out.set_of(k))
            common = _common(own, all_, rows)
            sizes = np.diff(all_.ends)[rows]
            for n in rows[100 * common >= PERCENT * (len(own) + sizes - common)].tolist():
                a, b = root(int(out.component[k])), root(int(all_.component[n]))
                if a != b:
                    top[max(a, b)] = min(a, b)
                    found.append((int(out.node[k]), int(all_.node[n])))
    columns = list(zip(*found)) or [(), ()]
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])


def _large_bucket_links(apart: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links in the other buckets.  A bucket's members outside its main
    component meet all of its members in blocks of about ``BLOCK_ROWS`` by
    ``BLOCK_ROWS``; pairs are formed and confirmed inside the blocks."""
    many = apart.filter(F.col("members") > SMALL_BUCKET)
    sets = shingle_sets(stage(many.select("node").distinct()), nodes, docs)
    many = many.join(nodes.select("node", "signature").join(sets, "node"), "node")
    many = many.withColumn("_l", F.ceil(F.col("others") / F.lit(BLOCK_ROWS))).withColumn(
        "_r", F.ceil(F.col("members") / F.lit(BLOCK_ROWS))
    )
    columns, hashed = ["node", "component", "signature", "shingles"], F.xxhash64("node")

    def every(number: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(number) - 1))

    left = many.filter("component <> main").select("bucket", *columns, F.pmod(hashed, F.col("_l")).alias("l"), every("_r").alias("r"))
    right = many.select("bucket", *columns, F.pmod(hashed, F.col("_r")).alias("r"), every("_l").alias("l"))
    right = right.toDF(*right.columns)  # columns of its own: both sides come from one table
    keys = ["bucket", "l", "r"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_links_in_blocks, "a long, b long").distinct()


def links(nodes: DataFrame, docs: DataFrame) -> DataFrame | None:
    """(node, component) of all nodes linked to another; None without any."""
    buckets = nodes.select("node", F.posexplode("signature").alias("_band", "_key")).select(
        "node", F.col("_key").bitwiseOR(F.shiftleft(F.col("_band").cast("long"), BITS * ROWS)).alias("bucket")
    )
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("_l"), F.max("node").alias("_h")).filter("_l <> _h")
    members = stage(buckets.join(shared.select("bucket"), "bucket"))
    tested = stage(_hub_pairs(members))
    if tested.isEmpty():
        return None
    found = stage(confirmed(stage(alike(tested, nodes)), nodes, docs))
    groups = None if found.isEmpty() else stage(components(found))
    apart = stage(_apart(members, groups))
    pairs = _small_bucket_pairs(apart).join(tested, ["a", "b"], "left_anti")
    more = confirmed(stage(alike(stage(pairs), nodes)), nodes, docs)
    more = stage(more.union(_large_bucket_links(apart, nodes, docs)))
    if more.isEmpty():
        return groups
    return stage(components(found.union(more)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for every row."""
    rows = stage(sketch(docs))
    firsts = rows.filter("n_shingles > 0 and doc_id is not null").groupBy("low", "high").agg(
        F.min(F.struct("doc_id", "text_hash", "signature")).alias("s")
    )
    nodes = stage(firsts.select(
        "low", "high", F.col("s.doc_id").alias("node"), F.col("s.text_hash").alias("text_hash"),
        F.col("s.signature").alias("signature"),
    ))
    classes = nodes.select("low", "high", "node")
    groups = links(nodes, docs)
    if groups is not None:
        classes = classes.join(groups, "node", "left")
    else:
        classes = classes.withColumn("component", F.lit(None).cast("long"))
    classes = classes.select("low", "high", F.coalesce("component", "node").alias("_component"))
    ids = rows.drop("signature")
    placed = salted_join(ids, classes, ["low", "high"], "left", hot=hot_keys(ids, ["low", "high"]), hot_bounded=True)
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    component = F.when(linked, F.col("_component")).otherwise(F.col("doc_id"))
    return placed.select(
        "doc_id", "text_hash", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the near duplicates of a smaller id (and without
    repeated rows of the same id and text)."""
    verdicts = stage(near_duplicates(docs))
    key = ["doc_id", "text_hash"]
    drop = verdicts.filter("not kept").select(*key).distinct()
    repeated = verdicts.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    text_hash = free_name(docs.columns, "_text_hash")
    hashed = docs.withColumn(text_hash, F.xxhash64("text"))
    same = hashed["doc_id"].eqNullSafe(drop["doc_id"]) & (hashed[text_hash] == drop["text_hash"])
    stay = hashed.join(F.broadcast(drop) if drop.count() <= BROADCAST_IDS else drop, same, "left_anti")
    if not repeated.isEmpty():
        stay = stay.dropDuplicates(["doc_id", text_hash])
    return stay.select(*docs.columns)
