"""Best-fit packing of documents into sequences, with conflicts.

Texts are cut into pieces of at most ``capacity`` words; a full piece is a bin of
its own.  The others are placed in falling length: bins stand ordered by
residual room, and from the first that is wide enough the search goes on to
the next wider one until a bin is found whose bitmaps allow the piece, which is
then the tightest compatible bin.  A bin's bitmaps hold the sources and the
duplicate clusters it has; it takes at most one piece of each.

Pieces are dealt by hash into groups of about ``group_rows`` and packed group by
group, so no source, cluster or document loads one task; what is lost is at
most the last open bins of each group.

Defined results: null and empty texts have no words: one row with a null bin.
A null source conflicts with nothing.  The cluster is what the caller names (a
component of near duplicates, or the document that rows are parts of), and the
text itself where that is null or not given: then copies and repeated rows never
share a bin, and neither do two pieces of one text.  Ties in length go by
cluster, text hash, piece number and id (as text); equal rows are
interchangeable.  Reruns agree.  Pieces cover every word, long texts included.
An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depuse.llm.longs import as_longs
from depuse.llm.staging import small_batches, stage
from depuse.llm.words import count_words

CAPACITY = 1024
GROUP_ROWS = 4096
# Bins of a group are numbered below this, from the group's number times this on.
BINS_PER_GROUP = 1 << 20
PIECES = "doc_id string, piece int, first_word int, n_words int, source string, cluster long, text_hash long, text string"
RESULT = (
    "bin_id long, place int, doc_id long, piece int, first_word int, n_words int, source string, cluster long, text_hash long, "
    "text string"
)


def best_fit(lengths: Sequence[int], sources: Sequence, clusters: Sequence, capacity: int = CAPACITY) -> list[int]:
    """Bin number of each piece, given in falling length.

    ``order`` holds (room, bin), narrowest first; bit ``i`` of a bin's bitmap
    says that it has the i-th source (or cluster) of this group.
    """
    bit: dict = {}
    order: list[tuple[int, int]] = []
    bitmaps: list[int] = []
    out = []
    for length, source, cluster in zip(lengths, sources, clusters):
        wanted = 1 << bit.setdefault(("cluster", cluster), len(bit))
        if source is not None:
            wanted |= 1 << bit.setdefault(("source", source), len(bit))
        at = bisect.bisect_left(order, (length, -1))
        while at < len(order) and bitmaps[order[at][1]] & wanted:
            at += 1
        if at < len(order):
            room, number = order.pop(at)
        else:
            room, number = capacity, len(bitmaps)
            bitmaps.append(0)
        bitmaps[number] |= wanted
        out.append(number)
        if room > length:
            bisect.insort(order, (room - length, number))
    return out


def _pieces(capacity: int, with_text: bool):
    from depuse.llm.pieces import cut

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, numbers, texts, firsts, sizes = [], [], [], [], []
            for at, (text, n) in enumerate(zip(batch["text"] if with_text else batch["cluster"], batch["n_words"])):
                spans = [(f, min(f + capacity, n)) for f in range(0, n, capacity)] or [(0, 0)]
                rows += [at] * len(spans)
                numbers += range(len(spans))
                firsts += [f for f, _ in spans]
                sizes += [t - f for f, t in spans]
                texts += cut(text, spans, n) if with_text and n else [text if with_text else None] * len(spans)
            out = batch[["doc_id", "source", "cluster", "text_hash"]].iloc[rows].reset_index(drop=True)
            out["piece"], out["first_word"], out["n_words"], out["text"] = numbers, firsts, sizes, texts
            yield out

    return parts


def pack(
    docs: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, with_text: bool = True,
    cluster: Column | None = None,
) -> DataFrame:
    """``RESULT``: one row per piece with its bin and its place in the bin;
    doc_id and text_hash tell whose piece it is.

    ``cluster``: a long column of ``docs``; rows that share one never share a bin.
    """
    small_batches(docs)
    text = [F.col("text")] if with_text else []
    text_hash = F.xxhash64("text")
    rows = docs.select(
        F.col("doc_id").cast("long").cast("string"), F.col("source").cast("string"),
        (text_hash if cluster is None else F.coalesce(cluster.cast("long"), text_hash)).alias("cluster"),
        text_hash.alias("text_hash"), count_words(F.col("text")).cast("int").alias("n_words"), *text,
    )
    pieces = rows.mapInPandas(_pieces(capacity, with_text), PIECES)
    if with_text:
        total = docs.select(F.sum(F.greatest(F.lit(1), F.ceil(count_words(F.col("text")) / F.lit(capacity))))).first()[0] or 0
    else:  # a few bytes a piece: written once, so that the texts are read once
        pieces = stage(pieces)
        total = pieces.count()
    groups = max(1, -(-int(total) // group_rows))
    key = F.xxhash64("doc_id", "text_hash", "piece")
    dealt = pieces.withColumn("_key", key).withColumn("_group", F.pmod(F.col("_key"), F.lit(groups)).cast("int"))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_words", "cluster", "text_hash", "piece", "doc_id"], ascending=[False, True, True, True, True], kind="stable")
        n = group["n_words"].to_numpy()
        placed = n > 0
        some = group[placed]
        bins = best_fit(
            n[placed].tolist(), [s if isinstance(s, str) else None for s in some["source"]], some["cluster"].tolist(), capacity
        )
        out = group.drop(columns=["_key", "_group"])
        ids = pd.array([pd.NA] * len(out), dtype="Int64")
        ids[placed] = np.array(bins, np.int64) + int(group["_group"].iloc[0]) * BINS_PER_GROUP
        out["bin_id"] = ids
        out["place"] = out.groupby("bin_id").cumcount() if len(some) else 0
        return out[[f.split(" ")[0] for f in RESULT.split(", ")]]

    placed = dealt.groupBy("_group").applyInPandas(place, RESULT.replace("doc_id long", "doc_id string"))
    return as_longs(placed, ["doc_id"])
