"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A profile is the ``PROFILE`` most frequent letter n-grams (1 to 3 letters, words
padded with a space on either side) by rank.  A document's profile is compared
with each language's by the out-of-place distance: how many ranks apart an
n-gram stands, the full profile length if the language lacks it.  The nearest
language wins.

Language profiles are counted on the executors over a bounded sample: at most
``train_documents`` documents per language (smallest id hashes), whole texts; the languages are few
(``train_documents`` ids each are broadcast).
Only the finished profiles (``PROFILE`` rows a language) reach the driver.

Defined results: ``lang_pred`` is ``und`` and ``score`` 0 for a null text, one
without a letter, or when nothing could be learned.  ``score`` is 1 minus the
distance as a share of the largest possible.  Ties go to the smaller n-gram
code, then to the first language by code point.  ``held_out``: crc32 of the id
as text, modulo 5, is 0 (null ids: false, but never learned from).  Long texts
are read whole; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depuse.llm.longs import as_longs, as_text, fields
from depuse.llm.staging import small_batches
from depuse.operators.topn import top_rows

PROFILE = 400
LONGEST = 3
TRAIN_DOCUMENTS = 400
FOLDS = 5
UNKNOWN = "und"
CHUNK_CHARS = 300_000
RESULT = "lang_pred string, score double"


class _Letters:
    """Code point to lower-case letter; 0 for anything that is no letter."""

    table = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            table = np.zeros(0x110000, np.uint64)
            for i in range(0x110000):
                c = chr(i)
                if c.isalpha():
                    low = c.lower()
                    table[i] = ord(low) if len(low) == 1 else i
            cls.table = table
        return cls.table


def ngrams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of ``texts`` and the number of each one's text.

    A code packs up to three letters, 21 bits each; a word's border is the
    letter ``' '``.  N-grams that would span two words are left out.
    """
    joined = " " + "  ".join(texts) + " "
    lengths = np.array([len(t) + 2 for t in texts])
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _Letters.get()[code]
    owner = np.repeat(np.arange(len(texts)), lengths)
    border = letter == 0
    c = np.where(border, np.uint64(32), letter)
    codes, owners = [], []
    for n in range(1, LONGEST + 1):
        packed = c[: len(c) - n + 1].copy()
        for j in range(1, n):
            packed |= c[j: len(c) - n + 1 + j] << np.uint64(21 * j)
        keep = np.ones(len(packed), bool)
        if n == 1:
            keep = ~border
        else:
            for j in range(1, n - 1):
                keep &= ~border[j: len(packed) + j]  # no border inside
            keep &= ~(border[: len(packed)] & border[n - 1: n - 1 + len(packed)]) if n == 2 else True
        codes.append(packed[keep])
        owners.append(owner[: len(packed)][keep])
    return np.concatenate(codes), np.concatenate(owners)


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and their counts."""
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    codes = np.sort(codes)
    at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[at], np.diff(np.append(at, len(codes)))


def profile(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes, most frequent first; ties by code."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        some = counts >= least
        codes, counts = codes[some], counts[some]
    return codes[np.lexsort((codes, -counts))][:size]


class Languages:
    """Rank of every profile n-gram in every language."""

    def __init__(self, profiles: dict[str, Sequence[int]], size: int = PROFILE):
        self.names, self.size = sorted(profiles), size
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.uint64))
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, np.int32)
        for k, name in enumerate(self.names):
            own = np.array(profiles[name], np.uint64)
            self.ranks[np.searchsorted(self.codes, own), k] = np.arange(len(own))

    def nearest(self, grams: np.ndarray) -> tuple[str, float]:
        """Language and score of a document's profile."""
        if not len(grams) or not self.names:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, grams)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != grams)] = len(self.codes)
        ranks = self.ranks[at]
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(grams), dtype=np.int32)[:, None]))
        distance = away.sum(0)
        best = int(np.argmin(distance))
        return self.names[best], 1.0 - float(distance[best]) / (self.size * len(grams))


def _chunks(texts: pd.Series) -> Iterator[list[str]]:
    chunk, chars = [], 0
    for at, text in enumerate(texts):
        chunk.append(text if isinstance(text, str) else "")
        chars += len(chunk[-1])
        if chars >= CHUNK_CHARS or at == len(texts) - 1:
            yield chunk
            chunk, chars = [], 0


def fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(FOLDS))


def learn(docs: DataFrame, train_documents: int = TRAIN_DOCUMENTS, size: int = PROFILE) -> dict[str, list[int]]:
    """Profiles by language, from documents outside the held-out fold."""
    known = docs.filter(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 0))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = top_rows(known.select("doc_id", "lang"), ["lang"], by_hash, train_documents, ["doc_id"]).distinct()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                for chunk in _chunks(rows["text"]):
                    codes, counts = counted(ngrams(chunk)[0])
                    yield pd.DataFrame({"lang": lang, "code": codes.astype(np.int64), "n": counts})

    counts = (
        known.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
        .select("lang", "text").mapInPandas(count, "lang string, code long, n long")
        .groupBy("lang", "code").agg(F.sum("n").alias("n"))
    )
    top = top_rows(counts, ["lang"], [F.desc("n"), F.asc("code")], size, ["code"], out="_r")
    found: dict[str, list[int]] = {}
    for row in sorted(top.select("lang", "_r", "code").collect()):
        found.setdefault(row["lang"], []).append(row["code"])
    return found


def identify(docs: DataFrame, profiles: dict[str, Sequence[int]], keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score`` from the text alone."""
    small_batches(docs)
    languages = Languages(profiles)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = [], []
            for chunk in _chunks(batch["text"]):
                codes, owners = ngrams(chunk)
                # n-grams of one length stand in text order: part them per text
                edges = np.flatnonzero(np.diff(owners) < 0) + 1
                runs = list(zip(np.split(codes, edges), np.split(owners, edges)))
                bounds = [np.searchsorted(o, np.arange(len(chunk) + 1)) for _, o in runs]
                for k in range(len(chunk)):
                    own = np.concatenate([c[b[k]:b[k + 1]] for (c, _), b in zip(runs, bounds)])
                    name, score = languages.nearest(profile(*counted(own), languages.size))
                    names.append(name)
                    scores.append(score)
            out = batch[list(keep)].reset_index(drop=True)
            out["lang_pred"], out["score"] = names, scores
            yield out

    rows, longs = as_text(docs.select(*keep, *(() if "text" in keep else ("text",))), keep)
    return as_longs(rows.mapInPandas(judge, f"{fields(rows, keep)}, {RESULT}"), longs)
