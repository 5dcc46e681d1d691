"""Quality rules: lines labelled content or boilerplate by a linear-chain
conditional random field, and documents kept by their share of content.

Each line gives binary features (shares of symbols, capitals and digits, word
counts, repetition, link and legal wording); Viterbi decoding finds the best
label sequence of a whole document.  The field is trained here, on a bounded
sample of labelled documents (``train_documents`` per quality class, those of
the smallest id hashes, one row an id, ``DOCUMENT_LINES`` lines each); a line's training label is its document's quality.

Defined results: words are runs of ``[^\\x20\\x09-\\x0D]``; a null or empty text
has none, fails the base rules and is dropped.  ``base_failed``: fewer than
``MIN_WORDS`` words, or words in repeated 8-word windows above
``MAX_REPEAT_PERCENT`` percent.  ``kept``: base rules passed and at least
``MIN_CONTENT_SHARE`` of the word characters stand in content lines.  Long texts
are read whole, repeated rows judged alike, null ids allowed; an empty table
gives no rows.  Without labelled documents of both kinds the built-in weights
(``DEFAULT_WEIGHTS``) are used.
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

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
MIN_CONTENT_SHARE = 0.5
TRAIN_DOCUMENTS = 500
TRAIN_LINES = 32  # training sequences are runs of this many lines
DOCUMENT_LINES = 4096  # lines of one document that training reads at most
CHUNK_CHARS = 300_000
MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, content_share double, kept boolean"
)

# The symbols of the base rule, wording of legal and site lines.
SYMBOLS = "#*$%&|<>"
LEGAL = ("license", "licence", "copyright", "all rights reserved", "cookie", "privacy policy", "terms of use", "terms of service")

FEATURES = (
    "bias", "no_words", "symbols_some", "symbols_many", "marks_many", "capitals_some", "capitals_most", "digits_many",
    "words_1_2", "words_3_7", "words_8_30", "words_over_30", "ends_open", "seen_before", "word_again", "words_again_many",
    "bars", "legal",
)
# Positive is content.  Used when there is nothing to train on.
DEFAULT_WEIGHTS = np.array([1.0, 0, -1, -3, -3, -0.5, -3, -1, 0, 0.5, 0.5, 0.5, -0.5, -1, -1, -3, -2, -1])
DEFAULT_TRANSITION = np.array([[0.5, -0.5], [-0.5, 0.5]])

_WHITE = np.zeros(0x110000, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(0x110000, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


class _Tables:
    """Character classes by code point, built once per worker."""

    made = None

    def __init__(self):
        chars = [chr(i) for i in range(0x3000)]  # classes of the cased scripts; others count as plain
        self.upper, self.digit, self.other = (np.zeros(0x110000, bool) for _ in range(3))
        self.upper[: len(chars)] = [c.isupper() for c in chars]
        self.digit[: len(chars)] = [c.isdigit() for c in chars]
        self.other[: len(chars)] = [not c.isalnum() and not c.isspace() and c not in ".,;:'\"-()?" for c in chars]
        self.letter = np.zeros(0x110000, bool)
        self.letter[: len(chars)] = [c.isalpha() for c in chars]

    @classmethod
    def get(cls) -> _Tables:
        if cls.made is None:
            cls.made = cls()
        return cls.made


def _legal(text: str) -> bool:
    low = text.lower()
    return any(phrase in low for phrase in LEGAL)


def _ranked(ids: np.ndarray) -> np.ndarray:
    """Dense numbers of equal values."""
    return np.unique(ids, return_inverse=True)[1].astype(np.int64)


def repeated_words(ids: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Per document, its words inside windows of ``WINDOW`` words found twice
    or more in the document.  Windows get exact numbers by doubling: pairs of
    words, pairs of pairs, and again."""
    out = np.zeros(docs, np.int64)
    if len(ids) < WINDOW:
        return out
    number, width = ids * docs + doc, 1
    while width < WINDOW:
        number = _ranked(number)
        number = number[:-width] * (number.max() + 1) + number[width:]
        width *= 2
    inside = doc[: len(number)] == doc[WINDOW - 1:]
    at = np.flatnonzero(inside)
    again = _ranked(number[at])
    at = at[np.bincount(again)[again] > 1]
    steps = np.bincount(at, minlength=len(ids) + 1) - np.bincount(at + WINDOW, minlength=len(ids) + 1)
    covered = np.cumsum(steps)[:-1] > 0
    return np.bincount(doc[covered], minlength=docs)


def measure(texts: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Base counts per document; per line its document, feature bits and word
    characters."""
    docs = len(texts)
    tables = _Tables.get()
    code = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    breaks = code == 10
    # the joining line breaks end documents; the others end lines
    doc_ends = np.cumsum([len(t) + 1 for t in texts])
    white = _WHITE[code]
    starts = ~white
    starts[1:] &= white[:-1]
    line = np.cumsum(breaks) - breaks  # a line break belongs to the line it ends
    lines = int(breaks.sum()) + 1
    line_texts = "\n".join(texts).split("\n")
    line_doc = np.searchsorted(doc_ends, np.concatenate(([0], np.flatnonzero(breaks) + 1)), side="right").clip(0, docs - 1)
    per_line = lambda mask: np.bincount(line[mask], minlength=lines)
    chars, words = per_line(~white), per_line(starts)
    symbols, upper, digit = per_line(_SYMBOL[code]), per_line(tables.upper[code]), per_line(tables.digit[code])
    letters, marks = per_line(tables.letter[code]), per_line(tables.other[code])
    bars = per_line(code == ord("|"))

    tokens = "\n".join(texts).encode("utf-8", "surrogatepass").split()
    ids = pd.factorize(np.array(tokens, object))[0].astype(np.int64) if tokens else np.zeros(0, np.int64)
    word_line = line[starts]
    word_doc = line_doc[word_line]
    again = np.zeros(len(ids), bool)
    if len(ids) > 1:
        again[1:] = (ids[1:] == ids[:-1]) & (word_line[1:] == word_line[:-1])
    repeats = np.bincount(word_line[again], minlength=lines)

    seen = np.zeros(lines, bool)
    legal = np.zeros(lines, bool)
    open_end = np.zeros(lines, bool)
    before: set[str] = set()
    last, wordy = -1, False
    for k, (text, d, n) in enumerate(zip(line_texts, line_doc.tolist(), words.tolist())):
        if d != last:
            before, last, wordy = set(), d, _legal(texts[d])
        if n:
            if text in before:
                seen[k] = True
            before.add(text)
            open_end[k] = text.rstrip()[-1:] not in ".!?…"
            legal[k] = wordy and _legal(text)
    full, cased, n = np.maximum(chars, 1), np.maximum(letters, 1), words
    columns = [
        np.ones(lines, bool), n == 0, symbols > 0.02 * full, symbols > 0.1 * full, marks > 0.1 * full,
        upper > 0.3 * cased, upper > 0.6 * cased, digit > 0.3 * full, (n > 0) & (n <= 2), (n > 2) & (n <= 7),
        (n > 7) & (n <= 30), n > 30, open_end, seen, repeats > 0, repeats * 4 > n, bars > 0, legal,
    ]
    bits = sum(c.astype(np.int64) << k for k, c in enumerate(columns))
    total = lambda x: np.bincount(line_doc, weights=x, minlength=docs).astype(np.int64)
    base = {
        "n_words": total(words), "word_chars": total(chars), "n_symbols": total(symbols), "n_dup_lines": total(seen),
        "n_repeat_words": repeated_words(ids, word_doc, docs),
    }
    return base, line_doc, bits, chars


def _features(bits: np.ndarray) -> np.ndarray:
    return ((bits[..., None] >> np.arange(len(FEATURES))) & 1).astype(float)


def train(sequences: list[tuple[np.ndarray, int]], rounds: int = 80, rate: float = 0.3, decay: float = 1e-3):
    """Weights (content against boilerplate) and 2 x 2 transitions that raise
    the likelihood of the labels; ``sequences`` holds feature bits per line and
    one label per sequence.  Forward-backward, all sequences side by side."""
    sequences = [
        (b[i:i + TRAIN_LINES], y) for b, y in sequences for i in range(0, len(b), TRAIN_LINES)
    ]
    longest = max(len(b) for b, _ in sequences)
    bits, mask = np.zeros((len(sequences), longest), np.int64), np.zeros((len(sequences), longest))
    for k, (b, _) in enumerate(sequences):
        bits[k, : len(b)], mask[k, : len(b)] = b, 1
    label = np.array([y for _, y in sequences])
    x = _features(bits)
    w, t = np.zeros(len(FEATURES)), np.zeros((2, 2))
    m1, m2 = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    n, pairs = mask.sum(), max(mask[:, 1:].sum(), 1)
    told_t = np.zeros((2, 2))
    for y in (0, 1):
        told_t[y, y] = mask[label == y][:, 1:].sum()
    for step in range(1, rounds + 1):
        unary = np.stack([np.zeros_like(mask), x @ w], -1)
        fwd = np.zeros_like(unary)
        fwd[:, 0] = unary[:, 0]
        for i in range(1, longest):
            nxt = np.logaddexp(fwd[:, i - 1, :1] + t[0], fwd[:, i - 1, 1:] + t[1]) + unary[:, i]
            fwd[:, i] = np.where(mask[:, i, None] > 0, nxt, fwd[:, i - 1])
        back = np.zeros_like(unary)
        for i in range(longest - 2, -1, -1):
            ahead = back[:, i + 1] + unary[:, i + 1]
            prev = np.logaddexp(ahead[:, :1] + t[:, 0], ahead[:, 1:] + t[:, 1])
            back[:, i] = np.where(mask[:, i + 1, None] > 0, prev, back[:, i + 1])
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        p1 = np.exp(fwd[:, :, 1] + back[:, :, 1] - z[:, None]) * mask
        grad_w = np.einsum("si,sif->f", (label[:, None] * mask) - p1, x) / n
        joint = fwd[:, :-1, :, None] + t + (unary + back)[:, 1:, None, :] - z[:, None, None, None]
        grad_t = (told_t - (np.exp(np.minimum(joint, 0)) * mask[:, 1:, None, None]).sum((0, 1))) / pairs
        g = np.concatenate([grad_w - decay * w, (grad_t - decay * 10 * t).ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        w, t = w + move[: len(w)], t + move[len(w):].reshape(2, 2)
    return w, t


def viterbi(content: list[float], transition: list[list[float]]) -> list[bool]:
    """Best labels of one document; ``content`` is each line's score for
    content (boilerplate scores 0).  Ties go to content."""
    (t00, t01), (t10, t11) = transition
    bad, good = 0.0, content[0] if content else 0.0
    back = []
    for c in content[1:]:
        from_bad_b, from_good_b = bad + t00, good + t10
        from_bad_g, from_good_g = bad + t01, good + t11
        back.append((from_good_b >= from_bad_b, from_good_g >= from_bad_g))
        bad = from_good_b if back[-1][0] else from_bad_b
        good = (from_good_g if back[-1][1] else from_bad_g) + c
    state = good >= bad
    out = [state]
    for to_bad, to_good in reversed(back):
        state = to_good if state else to_bad
        out.append(state)
    return out[::-1][: len(content)]


def _chunks(texts: pd.Series) -> Iterator[tuple[int, list[str]]]:
    begin, chunk, chars = 0, [], 0
    for at, text in enumerate(texts):
        chunk.append(text if isinstance(text, str) else "")
        chars += len(chunk[-1])
        if chars >= CHUNK_CHARS or at == len(texts) - 1:
            yield begin, chunk
            begin, chunk, chars = at + 1, [], 0


def judged(texts: list[str], weights: np.ndarray, transition: np.ndarray) -> pd.DataFrame:
    """The columns of ``MEASURES`` for each text."""
    base, line_doc, bits, chars = measure(texts)
    scores = _features(bits) @ weights
    t = transition.tolist()
    edges = np.searchsorted(line_doc, np.arange(len(texts) + 1))
    share = np.zeros(len(texts))
    for d, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        content = np.array(viterbi(scores[a:b].tolist(), t), bool)
        share[d] = chars[a:b][content].sum() / max(base["word_chars"][d], 1)
    failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
    return pd.DataFrame({**base, "base_failed": failed, "content_share": share, "kept": ~failed & (share >= MIN_CONTENT_SHARE)})


def _spread(bits: np.ndarray, most: int) -> np.ndarray:
    return bits if len(bits) <= most else bits[np.arange(most) * len(bits) // most]


def training_sample(
    docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCUMENTS, per_document: int = DOCUMENT_LINES
) -> list[tuple[np.ndarray, int]]:
    """Feature bits of at most ``per_class`` documents of quality 0 and as many
    of quality 1 (smallest id hashes), one row an id (smallest text hash) and at
    most ``per_document`` lines a document, spread evenly over it; only these
    bits reach the driver."""
    known = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    )
    chosen = top_rows(known, ["quality"], [F.xxhash64("doc_id"), F.col("doc_id")], per_class, ["doc_id"])

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin, texts in _chunks(batch["text"]):
                _, line_doc, bits, _ = measure(texts)
                edges = np.searchsorted(line_doc, np.arange(1, len(texts)))
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].to_numpy()[begin:begin + len(texts)],
                    "quality": batch["quality"].to_numpy()[begin:begin + len(texts)],
                    "bits": [_spread(b, per_document).tolist() for b in np.split(bits, edges)],
                })

    # 2 * per_class ids at most
    sample = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")
    sample = sample.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = sample.mapInPandas(lines, "doc_id long, quality int, bits array<long>").collect()
    found.sort(key=lambda r: (r["doc_id"], len(r["bits"])))
    return [(np.array(r["bits"], np.int64), r["quality"]) for r in found]


def label_quality(
    docs: DataFrame, labels: DataFrame | None = None, keep: Sequence[str] | None = None,
    train_documents: int = TRAIN_DOCUMENTS,
) -> DataFrame:
    """The ``keep`` columns of ``docs`` (default: all) with the columns of
    ``MEASURES``, which replace any of the same name."""
    small_batches(docs)
    sample = training_sample(docs, labels, train_documents) if labels is not None else []
    weights, transition = DEFAULT_WEIGHTS, DEFAULT_TRANSITION
    if len({y for _, y in sample}) == 2:
        weights, transition = train(sample)
    measures = [m.strip().rsplit(" ", 1)[0] for m in MEASURES.split(",")]
    carried = [c for c in (docs.columns if keep is None else keep) if c not in measures]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin, texts in _chunks(batch["text"]):
                given = batch.iloc[begin:begin + len(texts)].reset_index(drop=True)
                yield pd.concat([given[carried], judged(texts, weights, transition)], axis=1)

    rows, longs = as_text(docs.select(*carried, *(() if "text" in carried else ("text",))), carried)
    return as_longs(rows.mapInPandas(judge, f"{fields(rows, carried)}, {MEASURES}"), longs)
