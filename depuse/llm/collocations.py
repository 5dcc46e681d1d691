"""Phrase collocations by multikey three-way quicksort of suffix pointers.

Every word of a piece of text starts a suffix, cut off after ``max_words``
words or at the piece's end.  Sorted by their words, the suffixes that share
their first d words lie together, and the size of that group is the number of
times the d-word phrase occurs.  A three-way quicksort keyed word by word finds
these groups as its "equal" partitions and needs only go down where they are
large: a partition below ``min_count`` is abandoned, for nothing in it can
reach the count.

On Spark:

1. Word counts: map tasks count their own words, an aggregation adds up.  The
   ``hot`` words, those with more occurrences than one route is meant to hold,
   are few by that definition (at most ``routes``, which is bounded) and go to
   the driver.
2. Routing: a map task merges equal suffixes of a block of text (their
   occurrences become a weight) and deals them by a hash of their leading words:
   the first one, or, where that is hot, all up to the first word that is not.
   So no route holds a hot word's suffixes alone.  All suffixes of a block for
   one route travel as one row: their words, once each, and word numbers.
3. A route's task numbers its words and sorts pointers to the suffixes.  A
   phrase of hot words only is found in several routes with part of its count;
   those parts are kept whatever their size and added up afterwards.
4. Counts of the parts of a phrase come from the same tables by joins; scores
   are whole numbers in 38 decimal digits, exact up to counts of 10^15.

Defined results:

* a null text is empty, a null group is ``und``; an empty table gives no rows.
* ids take no part: repeated rows count again; extra columns are ignored.
* very long texts are cut into slices between words; the words before a slice's
  end wait for the next one, so phrases over the seam count once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depuse.llm.staging import stage
from depuse.operators.skew import salted_join
from depuse.operators.topn import top_rows

MIN_COUNT = 10
MAX_WORDS = 3
TOP = 2000
SCALE = 1_000_000
INSIDE_PERCENT = 50
ROUTE_WORDS = 400_000  # word occurrences a route is meant to hold
MIN_ROUTES, MAX_ROUTES = 512, 1_000_000
BLOCK_WORDS = 1_000_000
SLICE_BYTES = 4_000_000

_BREAK = b"."  # stands for every character that parts pieces
_FOLD = bytes(
    0x2E if chr(b) in ".,;:!?\n\x0b\x0c\r" else 0x20 if b == 0x09 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)
)


def tokens_of(text: str) -> Iterator[list[bytes]]:
    """Folded words and breaks of a text, some ``SLICE_BYTES`` at a time."""
    data = text.encode().translate(_FOLD)
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > SLICE_BYTES:
            cuts = [c for c in (data.find(b" ", at + SLICE_BYTES), data.find(_BREAK, at + SLICE_BYTES)) if c >= 0]
            end = min(cuts, default=end)
        yield data[at:end].replace(_BREAK, b" . ").split()
        at = end


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[str, str]]:
    for group, text in zip(batch.column("grp").to_pylist(), batch.column("text").to_pylist()):
        if text:
            yield group, text


def word_counts(texts: DataFrame, most: int = 300_000) -> DataFrame:
    """(grp, word, f) of every word; ``texts`` is (grp, text)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def rows() -> pa.RecordBatch:
            found = [(g, w.decode(), n) for g, c in counts.items() for w, n in c.items() if w != _BREAK]
            counts.clear()
            columns = list(zip(*found)) or [[], [], []]
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())],
                names=["grp", "word", "f"],
            )

        for batch in batches:
            for group, text in _grouped(batch):
                counter = counts.setdefault(group, Counter())
                for tokens in tokens_of(text):
                    counter.update(tokens)
            if sum(map(len, counts.values())) >= most:
                yield rows()
        yield rows()

    return texts.mapInArrow(counted, "grp string, word string, f long").groupBy("grp", "word").agg(F.sum("f").alias("f"))


# -- map side: suffixes of a block, merged and dealt ---------------------------


class Block:
    """Suffixes of one group's words, gathered until the block is full."""

    def __init__(self, max_words: int):
        self.max_words = max_words
        self.numbers: dict[bytes, int] = {_BREAK: 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, tokens: list[bytes]) -> None:
        numbers = self.numbers
        self.parts.append(np.fromiter((numbers.setdefault(t, len(numbers)) for t in tokens), np.int64, len(tokens)))
        self.size += len(tokens)

    def take(self, last: bool) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(words, suffixes, weights) of the words gathered; unless ``last``
        those that still lack followers stay for the next block."""
        flow = np.concatenate([*self.parts, np.zeros(self.max_words, np.int64)] if last else self.parts)
        ends = max(0, len(flow) - self.max_words + 1)
        words = list(self.numbers)
        order = sorted(range(1, len(words)), key=words.__getitem__)
        place = np.zeros(len(words), np.int64)  # a break stays 0
        place[order] = np.arange(1, len(words))
        rest = [words[i] for i in flow[ends:]]
        flow = place[flow]
        columns = [flow[d:ends + d] for d in range(self.max_words)]
        for d in range(1, self.max_words):  # nothing follows a break
            columns[d] = np.where(columns[d - 1] == 0, 0, columns[d])
        suffixes = np.stack(columns, 1)[columns[0] > 0]
        suffixes, weights = _merged(suffixes, len(words))
        names = [b""] + [words[i] for i in order]
        self.numbers, self.parts, self.size = {_BREAK: 0}, [], 0
        if not last:
            self.add(rest)
        return names, suffixes, weights


def _merged(suffixes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and how often each occurs."""
    if not len(suffixes):
        return suffixes, np.zeros(0, np.int64)
    ranks = np.zeros(len(suffixes), np.int64)
    most = 1  # of the mixed numbers so far
    for column in suffixes.T:
        if most * words >= 2**63:  # number them anew, in order
            values, ranks = np.unique(ranks, return_inverse=True)
            most = len(values)
        ranks = ranks * words + column
        most *= words
    _, first, weights = np.unique(ranks, return_index=True, return_counts=True)
    return suffixes[first], weights


def route_of(names: Sequence[bytes], suffixes: np.ndarray, hot: set[bytes], routes: int) -> np.ndarray:
    """Route of every suffix, from its words up to the first that is not hot."""
    hashes = np.array([xxhash.xxh3_64_intdigest(n) for n in names], np.uint64)
    is_hot = np.array([n in hot for n in names])
    mix = hashes[suffixes[:, 0]]
    more = is_hot[suffixes[:, 0]]
    for d in range(1, suffixes.shape[1]):
        word = suffixes[:, d]
        mix = np.where(more, (mix ^ (mix >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[word], mix)
        more = more & is_hot[word]
    mix = (mix ^ (mix >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return ((mix >> np.uint64(33)) % np.uint64(routes)).astype(np.int64)


def _packed(names: list[bytes], suffixes: np.ndarray, weights: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """A row's own words and numbers."""
    used, numbers = np.unique(suffixes, return_inverse=True)
    own = names if len(used) == len(names) else [names[i] for i in used]
    if len(used) and used[0] != 0:
        own, numbers = [b"", *own], numbers + 1
    return b" ".join(own[1:]), numbers.reshape(suffixes.shape).T.astype("<u4").tobytes(), weights.astype("<u8").tobytes()


ROUTED = "route long, grp string, words binary, suffixes binary, weights binary"


def routed_suffixes(texts: DataFrame, hot: dict[str, set[bytes]], routes: int, max_words: int, block_words: int) -> DataFrame:
    """One row a (block, group, route): its merged suffixes."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, Block] = {}

        def rows(group: str, last: bool) -> pa.RecordBatch:
            names, suffixes, weights = blocks[group].take(last)
            to = route_of(names, suffixes, hot.get(group, set()), routes)
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[order])) + 1
            out = []
            for part in np.split(order, cuts) if len(order) else []:
                out.append((int(to[part[0]]), group, *_packed(names, suffixes[part], weights[part])))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["route", "grp", "words", "suffixes", "weights"]
            )

        for batch in batches:
            for group, text in _grouped(batch):
                block = blocks.setdefault(group, Block(max_words))
                for tokens in tokens_of(text):
                    block.add(tokens)
                    if block.size >= block_words:
                        yield rows(group, False)
                block.add([_BREAK])
            while sum(b.size for b in blocks.values()) >= block_words:
                yield rows(max(blocks, key=lambda g: blocks[g].size), False)
        for group in blocks:
            yield rows(group, True)

    return texts.mapInArrow(dealt, ROUTED)


# -- a route: the sort ----------------------------------------------------------


def equal_partitions(
    suffixes: np.ndarray, weights: np.ndarray, is_hot: np.ndarray, min_count: int
) -> Iterator[tuple[tuple[int, ...], int]]:
    """(phrase, count) of every group of suffixes that share their first words.

    ``suffixes`` holds word numbers (0: the suffix has ended), one row each.
    Phrases of hot words only are reported whatever their count, others from
    ``min_count`` on.
    """
    depth = suffixes.shape[1]
    whole = np.arange(len(suffixes))
    stack: list[tuple[np.ndarray, tuple[int, ...], bool]] = [(whole, (), True)]  # pointers, phrase so far, all hot
    while stack:
        at, phrase, hot_so_far = stack.pop()
        column = suffixes[:, len(phrase)]
        keys = column[at]
        at = at[keys > 0]
        if hot_so_far:
            hot = is_hot[column[at]]
            sides = [(at[hot], True), (at[~hot], False)]
        else:
            sides = [(at, False)]
        for pointers, keep_all in sides:
            least = 1 if keep_all else min_count
            parts = [(pointers, int(weights[pointers].sum()))]
            while parts:
                part, total = parts.pop()
                if total < least:
                    continue  # abandoned
                keys, weighing = column[part], weights[part]
                pivot = keys[len(keys) // 2]
                equal_part, n = part, total
                for side in (keys < pivot, keys > pivot):
                    beside = int(weighing[side].sum())
                    n -= beside
                    if beside >= least:
                        parts.append((part[side], beside))
                if n < least:
                    continue
                found = (*phrase, int(pivot))
                yield found, n
                if len(found) < depth:
                    if n < total:
                        equal_part = part[keys == pivot]
                    stack.append((equal_part, found, keep_all))


def phrase_counts(routed: DataFrame, hot: dict[str, set[bytes]], min_count: int, max_words: int) -> DataFrame:
    """(grp, phrase, n_words, f) of phrases of 2 and more words that occur
    ``min_count`` times or more; phrases are word lists."""

    def sort_route(rows: pd.DataFrame) -> pd.DataFrame:
        group = rows["grp"].iloc[0]
        numbers: dict[bytes, int] = {b"": 0}
        parts, weights = [], []
        for words, suffixes, w in zip(rows["words"], rows["suffixes"], rows["weights"]):
            own = [b"", *words.split(b" ")]
            number = np.fromiter((numbers.setdefault(x, len(numbers)) for x in own), np.int64, len(own))
            parts.append(number[np.frombuffer(suffixes, "<u4").reshape(max_words, -1).T])
            weights.append(np.frombuffer(w, "<u8").astype(np.int64))
        names = [x.decode() for x in numbers]
        is_hot = np.array([x in hot.get(group, ()) for x in numbers])
        found = [
            (group, [names[i] for i in phrase], len(phrase), n)
            for phrase, n in equal_partitions(np.concatenate(parts), np.concatenate(weights), is_hot, min_count)
            if len(phrase) > 1
        ]
        return pd.DataFrame(found, columns=["grp", "phrase", "n_words", "f"])

    counted = routed.groupBy("route", "grp").applyInPandas(sort_route, "grp string, phrase array<string>, n_words int, f long")
    return (
        counted.groupBy("grp", "phrase", "n_words").agg(F.sum("f").alias("f")).filter(F.col("f") >= min_count)
    )


# -- scores ----------------------------------------------------------------------


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def cut_scores(counts: DataFrame, words: DataFrame, scale: int) -> DataFrame:
    """Adds the phrase's lowest-scoring cut (l, r, score) to ``counts``, a
    stage table.  Both parts of every cut are asked for in one join."""
    sides = F.flatten(F.transform(
        F.sequence(F.lit(1), F.col("n_words") - 1),
        lambda k: F.array(
            F.struct(k.alias("k"), F.lit("l").alias("side"), F.slice("phrase", F.lit(1), k).alias("part")),
            F.struct(k.alias("k"), F.lit("r").alias("side"), F.slice("phrase", k + 1, F.col("n_words") - k).alias("part")),
        ),
    ))
    asked = counts.withColumn("_side", F.explode(sides)).select("grp", "phrase", "n_words", "f", "_side.*")
    single = words.select("grp", F.array("word").alias("part"), F.col("f").alias("part_f"))
    parts = counts.select("grp", F.col("phrase").alias("part"), F.col("f").alias("part_f")).unionByName(single)
    met = salted_join(asked, parts, ["grp", "part"])  # "the" ends very many phrases
    cuts = met.groupBy("grp", "phrase", "n_words", "f", "k").agg(
        *[F.max(F.when(F.col("side") == side, F.col("part_f"))).alias(side) for side in ("l", "r")]
    )
    whole = "cast({} as decimal(19,0))".format
    score = F.expr(f"cast(({scale} * ({whole('f')} * {whole('f')})) div ({whole('l')} * {whole('r')}) as long)")
    best = cuts.groupBy("grp", "phrase", "n_words", "f").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_cut"))
    return best.select("grp", "phrase", "n_words", "f", "_cut.l", "_cut.r", "_cut.score")


def _inner_phrases(counts: DataFrame, max_words: int) -> DataFrame:
    """(grp, phrase, longest count) of phrases inside longer ones."""
    inner = [
        F.slice("phrase", i + 1, size).alias("phrase")
        for size in range(2, max_words) for i in range(max_words - size + 1)
    ]
    whole = [(size, i) for size in range(2, max_words) for i in range(max_words - size + 1)]
    kept = [F.when(F.col("n_words") >= F.lit(max(i + size, size + 1)), p) for p, (size, i) in zip(inner, whole)]
    each = counts.filter("n_words > 2").select("grp", "f", F.explode(F.array_distinct(F.array(*kept))).alias("phrase"))
    return each.filter("phrase is not null").groupBy("grp", "phrase").agg(F.max("f").alias("longer_f"))


def collocations(
    docs: DataFrame, text: str = "text", group: str | None = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
    top: int = TOP, scale: int = SCALE, inside_percent: int = INSIDE_PERCENT, route_words: int = ROUTE_WORDS,
    min_routes: int = MIN_ROUTES, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """grp, rank, phrase, a, l, r, n, score: the ``top`` phrases of every group.

    A phrase has 2 to ``max_words`` words, all in one piece, and occurs ``a``
    >= ``min_count`` times; ``l`` and ``r`` count the parts of its
    lowest-scoring cut, ``n`` the group's words.  One that lies in a longer
    phrase with at least ``inside_percent`` of its count is left out.
    """
    if max_words < 2 or min_count < 1:
        raise ValueError("max_words must be >= 2 and min_count >= 1")
    name = F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("und")) if group else F.lit("und")
    texts = docs.select(name.alias("grp"), F.col(f"`{text}`").alias("text"))
    words = stage(word_counts(texts))
    total = words.agg(F.sum("f")).first()[0] or 0
    routes = min(MAX_ROUTES, max(min_routes, -(-total // route_words)))
    hot: dict[str, set[bytes]] = {}
    for r in words.filter(F.col("f") > max(1, total // routes)).collect():  # at most ``routes`` words
        hot.setdefault(r.grp, set()).add(r.word.encode())
    routed = routed_suffixes(texts, hot, routes, max_words, block_words)
    counts = stage(phrase_counts(routed, hot, min_count, max_words))
    scored = cut_scores(counts, words.filter(F.col("f") >= min_count), scale)
    if max_words > 2:
        longer = _inner_phrases(counts, max_words)
        scored = scored.join(longer, ["grp", "phrase"], "left").filter(
            F.col("longer_f").isNull() | (F.lit(100) * F.col("longer_f") < F.lit(inside_percent) * F.col("f"))
        )
    named = scored.select("grp", _joined(F.col("phrase")).alias("phrase"), F.col("f").alias("a"), "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = top_rows(named, ["grp"], order, top, ["phrase"], out="rank")
    sizes = words.groupBy("grp").agg(F.sum("f").alias("n"))
    return best.join(sizes, "grp").select("grp", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
