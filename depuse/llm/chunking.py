"""Substring dedup by content-defined chunking with a gear rolling hash.

Every word has a random 64-bit gear value; the rolling hash shifts 16 bits a
word and adds the next value, so it depends on the last ``4`` words only.  A
chunk ends where this hash is the smallest within ``RADIUS`` words either side:
cuts depend on nearby words alone, so an insertion moves the cuts around itself
and no others, and chunks hold more than ``RADIUS`` words.  The shortest
stretches of neighbouring chunks of at least ``MIN_RUN`` words, one from each
chunk on and one up to each chunk, are compared by the 96-bit digest of their
whole word sequence across all documents; the first occurrence (smallest id, then
text hash, then place) stays, and the others are repeated passages and are cut
from the text.  Every word cut is thus part of ``MIN_RUN`` words on that occur
earlier in that order; common chunks that merely meet are no passage.  The
first occurrence of a chunk is never cut.

Defined results: words are runs of ``[^\\x20\\x09-\\x0D]`` and compare by their
bytes.  Null and empty texts have no chunks and stay as they are.  Rows equal
in id and text are one document: all stay, or lose the same passages.  Null ids
sort last.  A text wholly repeated becomes empty.  Whole texts are chunked,
however long; stretches without a smallest hash (one word over and over) are one
chunk.  An empty table gives no rows.  Of the input only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depuse.llm.longs import as_longs, as_text
from depuse.llm.staging import small_batches, stage
from depuse.llm.words import WordHashes, mixed, words_of
from depuse.operators.skew import DEFAULT_MIN_SHARE, salted_join

GEAR_WORDS = 4
RADIUS = 3
MIN_RUN = 12
CHUNK_WORDS = 100_000
CHUNKS = "doc_id long, text_hash long, digest long, check int, place int, words int"
DIGEST = ["digest", "check"]
RESULT = "doc_id long, text string, n_words long, dup_words long, dup_spans array<array<int>>"

# Odd multipliers of the two digests, and what the second one's gears are mixed with.
_MULTIPLIERS = (0xD6E8FEB86659FD93, 0x9FB21C651E98DF25)
_OTHER_GEARS = np.uint64(0x5851F42D4C957F2D)


def gear_hashes(gears: np.ndarray) -> np.ndarray:
    """Rolling hash after every word."""
    out = gears.copy()
    for back in range(1, min(GEAR_WORDS, len(gears) + 1)):
        out[back:] += gears[:-back] << np.uint64(16 * back)
    return mixed(out)


def cuts(gears: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Chunk starts over the concatenated documents that begin at ``starts``:
    every document start, and the word after each smallest hash."""
    n = len(gears)
    h = gear_hashes(gears)
    top = np.uint64(2**64 - 1)
    least_before, least_after = np.full(n, top), np.full(n, top)
    for back in range(1, RADIUS + 1):
        if back < n:
            least_before[back:] = np.minimum(least_before[back:], h[:-back])
            least_after[:-back] = np.minimum(least_after[:-back], h[back:])
    smallest = (h < least_before) & (h <= least_after)
    first = np.zeros(n, bool)
    first[1:] = smallest[:-1]
    # where the window would reach beyond the document there is no cut
    ends = np.append(starts[1:], n)
    near = np.zeros(n + 2, np.int64)
    np.add.at(near, starts, 1)
    np.add.at(near, np.minimum(starts + RADIUS + GEAR_WORDS, n + 1), -1)
    np.add.at(near, np.maximum(ends - RADIUS + 1, starts), 1)
    np.add.at(near, ends + 1, -1)
    first &= np.cumsum(near)[:n] == 0
    first[starts] = True
    return np.flatnonzero(first)


def _digests(gears: np.ndarray, begins: np.ndarray, ends: np.ndarray, multiplier: int) -> np.ndarray:
    powers, inverse = np.ones((2, len(gears)), np.uint64)
    powers[1:], inverse[1:] = np.uint64(multiplier), np.uint64(pow(multiplier, -1, 2**64))
    sums = np.zeros(len(gears) + 1, np.uint64)
    sums[1:] = np.cumsum(mixed(gears) * np.cumprod(powers))
    return mixed((sums[ends] - sums[begins]) * np.cumprod(inverse)[begins] + (ends - begins).astype(np.uint64))


def digests(gears: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 more bits that stand for the word sequences [begin, end), which
    may overlap: at 10^13 different stretches fewer than 0.001 accidental pairs
    are expected."""
    check = _digests(gears ^ _OTHER_GEARS, begins, ends, _MULTIPLIERS[1]) >> np.uint64(32)
    return _digests(gears, begins, ends, _MULTIPLIERS[0]).view(np.int64), check.astype(np.uint32).view(np.int32)


def stretches(firsts: np.ndarray, starts: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the shortest runs of whole chunks with ``least`` words
    on, from each chunk and up to each chunk of its document; with 1, the
    chunks.  ``firsts`` and ``starts``: where chunks and documents begin."""
    ends = np.append(firsts[1:], n)
    owner = np.searchsorted(starts, firsts, side="right") - 1
    at = np.arange(len(firsts))
    last = np.searchsorted(ends, firsts + least)
    ahead = np.append(ends, n + 1)[last] <= np.append(starts[1:], n)[owner]
    first = np.searchsorted(firsts, ends - least, side="right") - 1
    back = (first >= 0) & (firsts[first] >= starts[owner])
    pairs = np.unique(np.concatenate((at[ahead] * len(at) + last[ahead], first[back] * len(at) + at[back])))
    return firsts[pairs // len(at)], ends[pairs % len(at)]


def _chunk(least: int):
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_hash")
            rows: list[int] = []
            gears: list[np.ndarray] = []
            count = 0
            for at, text in enumerate(batch.column("text")):
                words = words_of(text.as_py())
                if words:
                    rows.append(at)
                    gears.append(memo.of(words))
                    count += len(words)
                if rows and (count >= CHUNK_WORDS or at == batch.num_rows - 1):
                    flat = np.concatenate(gears)
                    starts = np.concatenate(([0], np.cumsum([len(g) for g in gears])[:-1]))
                    begins, ends = stretches(cuts(flat, starts), starts, len(flat), least)
                    owner = np.searchsorted(starts, begins, side="right") - 1
                    take = pa.array(np.array(rows)[owner])
                    digest, check = digests(flat, begins, ends)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(take), keys.take(take), pa.array(digest), pa.array(check),
                         pa.array((begins - starts[owner]).astype(np.int32)),
                         pa.array((ends - begins).astype(np.int32))],
                        ["doc_id", "text_hash", *DIGEST, "place", "words"],
                    )
                    rows, gears, count = [], [], 0

    return parts


def chunks(docs: DataFrame, least: int = 1) -> DataFrame:
    """One row per stretch of chunks of ``least`` words on (each chunk for 1):
    its document, digest, first word and word count."""
    small_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.filter("text is not null").mapInArrow(_chunk(least), CHUNKS)


def runs(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Neighbouring and overlapping (place, words) spans joined."""
    out: list[list[int]] = []
    for place, words in sorted(spans):
        if out and out[-1][0] + out[-1][1] >= place:
            out[-1][1] = max(out[-1][1], place + words - out[-1][0])
        else:
            out.append([place, words])
    return out


def repeated_spans(docs: DataFrame, least: int = 1) -> DataFrame:
    """(doc_id, text_hash, spans) of the documents with repeated stretches of
    ``least`` words on (chunks for 1); spans holds place and words of each
    stretch that occurs earlier elsewhere.

    Stretches meet by digest; a digest of very many is reduced to one row
    map-side and its rows are salted in the join back.  The counts of the digests
    that occur again tell which those are.
    """
    found = stage(chunks(docs, least))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "place")
    # equal rows count more than once, but all of them are the first
    first = found.groupBy(*DIGEST).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = stage(first)
    hot = first.filter(F.col("n") > F.lit(DEFAULT_MIN_SHARE * found.count())).select(*DIGEST)
    again = salted_join(found, first.drop("n"), DIGEST, hot=hot, hot_bounded=True).filter(order != F.col("first"))
    return again.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("place", "words")).alias("spans"))


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import re

    pattern = re.compile(r"[^\x20\x09-\x0D]+")
    for batch in batches:
        texts, counts, dups, kept_spans = [], [], [], []
        for text, spans, n in zip(batch["text"], batch["spans"], batch["n_words"]):
            gone = runs([(s["place"], s["words"]) for s in spans]) if spans is not None else []
            if gone:
                places = [m.span() for m in pattern.finditer(text)]
                begin, parts = 0, []
                for place, words in gone:
                    parts.append(text[begin:places[place][0]])
                    begin = places[place + words][0] if place + words < len(places) else len(text)
                parts.append(text[begin:])
                text = "".join(parts)
            texts.append(text)
            counts.append(n)
            dups.append(sum(w for _, w in gone))
            kept_spans.append(gone)
        yield pd.DataFrame({
            "doc_id": batch["doc_id"], "text": texts, "n_words": counts, "dup_words": dups, "dup_spans": kept_spans,
        })


def dedupe_passages(docs: DataFrame) -> DataFrame:
    """doc_id, the text without repeated passages, n_words, dup_words and
    dup_spans ([first word, words] of what was cut)."""
    from depuse.llm.words import count_words

    spans = repeated_spans(docs, MIN_RUN)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_hash"))
    same = rows["doc_id"].eqNullSafe(spans["doc_id"]) & (rows["_hash"] == spans["text_hash"])
    joined = rows.join(spans, same, "left").select(rows["doc_id"], "text", "spans", count_words(F.col("text")).alias("n_words"))
    rows, longs = as_text(joined, ["doc_id"])
    return as_longs(rows.mapInPandas(_cut, RESULT.replace("doc_id long", "doc_id string")), longs)
