"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix takes ``share`` times all words.  A source's target is its weight's
part of that, but at most ``most`` times its size; the excess goes to the
others by weight.  Each source's documents, in a seeded order, form one stream
of words cut into blocks of ``block_words``; the mix's blocks are awarded to the
sources one by one by the highest quotient target / (2 * awarded + 1), so every
output shard (a run of awards) has an integer quota per source.  Which blocks
fill a quota is a seeded permutation of the source's blocks: all are taken once
before any is taken again.  Awards are whole blocks, and a source's last block
is short; what a source then lacks of its target, or has beyond it, is settled
in words: the block after its last whole one is taken in part.  So every source
gets its target to the word, however small it is.

Defined results:

* null or empty texts have size 0 and are taken 0 times; a source of size 0
  has target 0; an empty table gives no rows.
* sources rank by code point, null last; weights repeat along that order.
* a document is taken at most ``most`` times over; long ones are cut at block
  borders.  Ties between equal quotients go to the earlier source.  Rows equal
  in all kept columns are interchangeable.  Reruns agree.
* extra columns are carried when named in ``keep``; those named like a column
  of the result are replaced.  ``mix_documents`` carries all, whatever their names.

Scale: the documents are summed per source on the executors; only that table,
one row a source, reaches the driver and is broadcast (``MAX_SOURCES`` rows at
most, an error beyond).  A weight a source is configuration; more sources than
that call for coarser ones.
"""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depuse.llm.longs import as_longs, as_text, fields
from depuse.llm.running import running_totals
from depuse.llm.staging import small_batches, stage
from depuse.llm.words import count_words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 128
OUTPUT_SHARDS = 16
SEED = 20
MAX_SOURCES = 100_000
RESULT = ("size", "source_size", "target", "taken")
PLAN = (
    "_rank int, source_size long, target double, _blocks long, _step long, _start long, _quota long, "
    "_whole long, _part_block long, _part long, _shard_ends array<long>"
)


def capped_targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> list[float]:
    """Shares by weight, none above ``most`` times its size; what a capped
    source cannot use is shared again by weight."""
    targets, left = [0.0] * len(sizes), share * sum(sizes)
    open_ = list(range(len(sizes)))
    while open_:
        unit = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if unit * weights[s] > most * sizes[s]]
        if not full:
            for s in open_:
                targets[s] = unit * weights[s]
            break
        for s in full:
            targets[s] = float(most * sizes[s])
            left -= targets[s]
        open_ = [s for s in open_ if s not in set(full)]
    return targets


def sainte_lague(votes: Sequence[float], seats: int, limits: Sequence[int]) -> list[int]:
    """Seats by the highest quotients votes / (2 * seats + 1), at most
    ``limits`` each.  Starts from rounded shares, which is the state at one
    common quotient, and adds or takes back the few awards beside it."""
    total = sum(votes)
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    out = [min(m, math.ceil(v * seats / total - 0.5)) for v, m in zip(votes, limits)]
    missing = seats - sum(out)
    if missing < 0:
        last = [(v / (2 * n - 1), -s) for s, (v, n) in enumerate(zip(votes, out)) if n]
        heapq.heapify(last)
        for _ in range(-missing):
            s = -heapq.heappop(last)[1]
            out[s] -= 1
            if out[s]:
                heapq.heappush(last, (votes[s] / (2 * out[s] - 1), -s))
    following = [(-v / (2 * n + 1), s) for s, (v, n, m) in enumerate(zip(votes, out, limits)) if n < m and v > 0]
    heapq.heapify(following)
    while missing > 0 and following:
        s = heapq.heappop(following)[1]
        out[s] += 1
        missing -= 1
        if out[s] < limits[s]:
            heapq.heappush(following, (-votes[s] / (2 * out[s] + 1), s))
    return out


def settled(size: int, want: int, blocks: int, quota: int, step: int, start: int, block_words: int) -> tuple[int, int, int]:
    """(whole picks, block of the pick after them, its words that are taken),
    so that a source with ``quota`` awards gives exactly ``want`` words."""
    if not blocks:
        return 0, 0, 0
    short = block_words * blocks - size  # words the last block lacks
    last = ((blocks - 1) * step + start) % blocks  # its place in a pass

    def words(picks: int) -> int:
        passes, more = divmod(picks, blocks)
        return passes * size + more * block_words - (short if last < more else 0)

    while quota and words(quota) > want:
        quota -= 1
    while words(quota + 1) <= want:
        quota += 1
    return quota, (quota - start) * pow(step, -1, blocks) % blocks, want - words(quota)


def block_plan(
    sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST,
    block_words: int = BLOCK_WORDS, shards: int = OUTPUT_SHARDS, seed: int = SEED,
) -> list[tuple]:
    """One row of ``PLAN`` per source, in rank order."""
    targets = capped_targets(sizes, [weights[r % len(weights)] for r in range(len(sizes))], share, most)
    blocks = [-(-n // block_words) for n in sizes]
    awards = round(sum(targets) / block_words)
    ends = [sainte_lague(targets, awards * (k + 1) // shards, [most * b for b in blocks]) for k in range(shards)]
    plan = []
    for r, (size, target, n) in enumerate(zip(sizes, targets, blocks)):
        draw = random.Random(f"{seed}:{r}")
        step = draw.randrange(1, 1 << 20)
        while n and math.gcd(step, n) != 1:
            step += 1
        start, quota = draw.randrange(max(n, 1)), ends[-1][r]
        want = min(round(target), most * size)
        rest = settled(size, want, n, quota, step, start, block_words)
        plan.append((r, size, target, n, step, start, quota, *rest, [e[r] for e in ends]))
    return plan


# How often the whole of block b of a source is taken: picks p, p + blocks, ...
# below the whole ones, where p is the block's place in the seeded permutation.
def _takes(block: str) -> str:
    return f"greatest(0L, (_whole - (({block} * _step + _start) % _blocks) + _blocks - 1L) div _blocks)"


def apportion(
    docs: DataFrame, keep: Sequence[str] = ("doc_id",), columns: Sequence[str] = ("doc_id", "source", "text"),
    weights: Sequence[float] = WEIGHTS, share: float = SHARE,
    most: int = MOST, block_words: int = BLOCK_WORDS, shards: int = OUTPUT_SHARDS, seed: int = SEED,
) -> DataFrame:
    """``keep`` columns with ``size``, ``source_size``, ``target`` and ``taken``,
    plus the columns of the plan (``_first``, ``_rank``, ...) for ``mix_documents``.
    ``columns`` names the columns of id, source and text."""
    doc_id, source, text = (F.col(c) for c in columns)
    rows = stage(docs.select(
        *(c for c in keep if c not in RESULT), source.alias("_source"), count_words(text).alias("_size"),
        F.xxhash64(F.lit(seed), doc_id, F.crc32(F.encode(text, "UTF-8"))).alias("_key"),
    ))
    spark = docs.sparkSession
    found = rows.groupBy("_source").agg(F.sum("_size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them before mixing")
    found.sort(key=lambda r: (r["_source"] is None, r["_source"] or ""))
    ranks = spark.createDataFrame([(r["_source"], k) for k, r in enumerate(found)], "_name string, _rank int")
    plan = spark.createDataFrame(
        block_plan([r["n"] for r in found], weights, share, most, block_words, shards, seed), PLAN
    )
    ranked = rows.join(F.broadcast(ranks), F.col("_source").eqNullSafe(F.col("_name"))).drop("_name", "_source")
    laid = running_totals(ranked, "_rank", "_key", ["_size"], "_size", "_first")
    b = F.lit(block_words)
    taken = F.expr(
        f"aggregate(sequence(_first div {block_words}L, (_first + _size - 1L) div {block_words}L), 0L, (t, b) -> "
        f"t + (least(_first + _size, (b + 1L) * {block_words}L) - greatest(_first, b * {block_words}L)) * {_takes('b')}) + "
        f"greatest(0L, least(_first + _size, _part_block * {block_words}L + _part) - greatest(_first, _part_block * {block_words}L))"
    )
    return (
        laid.join(F.broadcast(plan), "_rank")
        .withColumn("taken", F.when((F.col("_size") > 0) & (F.col("_blocks") > 0), taken).otherwise(F.lit(0).cast("long")))
        .withColumn("_block_words", b.cast("long"))
        .withColumnRenamed("_size", "size")
    )


def runs_taken(first: int, size: int, plan: dict) -> Iterator[tuple[int, int, int]]:
    """(pass, from word, to word) of each run of neighbouring blocks that the
    same pass over the source takes from a document's words."""
    width, blocks, whole = plan["_block_words"], plan["_blocks"], plan["_whole"]
    if not size or not blocks:
        return
    for turn in range(-(-(whole + (plan["_part"] > 0)) // blocks)):
        begin = None
        for b in range(first // width, (first + size - 1) // width + 1):
            pick = (b * plan["_step"] + plan["_start"]) % blocks + turn * blocks
            if pick <= whole and begin is None:
                begin = max(first, b * width)
            if pick >= whole and begin is not None:
                end = b * width + plan["_part"] * (pick == whole)
                if begin < min(end, first + size):
                    yield turn, begin - first, min(end, first + size) - first
                begin = None
        if begin is not None:
            yield turn, begin - first, size


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each run of
    blocks taken from a document, with that part of its text (all of it when
    every word is taken) and ``n_chars``, if present, set to its length."""
    from depuse.llm.pieces import cut  # text slices by word numbers

    small_batches(docs)
    # under names of their own, the columns cannot clash with the plan's
    own = {c: f"_c{k}" for k, c in enumerate(docs.columns)}
    text, chars = own["text"], own.get("n_chars")
    renamed = docs.toDF(*own.values())
    mixed = apportion(renamed, list(own.values()), [own[c] for c in ("doc_id", "source", "text")], **options)
    plan = ["_first", "_whole", "_part", "_blocks", "_step", "_start", "_block_words"]

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, texts = [], []
            for at, (whole, size, *given) in enumerate(zip(batch[text], batch["size"], *(batch[c] for c in plan))):
                spans = [(f, t) for _, f, t in runs_taken(given[0], size, dict(zip(plan, map(int, given))))]
                rows += [at] * len(spans)
                texts += cut(whole, spans, size)
            out = batch.iloc[rows][list(own.values())].reset_index(drop=True)
            out[text] = texts
            if chars:
                out[chars] = [str(len(t)) for t in texts] if chars in longs else [len(t) for t in texts]
            yield out

    rows, longs = as_text(mixed.filter("taken > 0").select(*own.values(), "size", *plan), list(own.values()))
    parted = rows.mapInPandas(parts, fields(rows, list(own.values())))
    return as_longs(parted, longs).toDF(*docs.columns)
