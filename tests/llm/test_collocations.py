import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from depuse.llm import collocations
from tests.llm.helpers import documents, frame

PIECE = re.compile(r"[.,;:!?\x0A-\x0D]")
WORD = re.compile(r"[^\x20\x09]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_count, max_words, top, scale=1_000_000, inside=50):
    f = {}
    for _, text, lang, *_ in rows:
        counts = f.setdefault("und" if lang is None else lang, Counter())
        for piece in PIECE.split((text or "").translate(FOLD)):
            words = WORD.findall(piece)
            for i, n in itertools.product(range(len(words)), range(1, max_words + 1)):
                if i + n <= len(words):
                    counts[tuple(words[i:i + n])] += 1
    out = set()
    for lang, counts in f.items():
        chosen = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        inside_of = Counter()
        for p, a in chosen.items():
            for i, j in itertools.combinations(range(len(p) + 1), 2):
                if 2 <= j - i < len(p):
                    inside_of[p[i:j]] = max(inside_of[p[i:j]], a)
        found = []
        for p, a in chosen.items():
            if p in inside_of and 100 * inside_of[p] >= inside * a:
                continue
            cuts = [(scale * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        n = sum(a for p, a in counts.items() if len(p) == 1)
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return out


def cases(seed=5):
    draw = random.Random(seed)
    rows = documents(seed)
    for k in range(60):
        words = []
        while len(words) < 80:
            words += draw.choice([["the"], ["of", "the"], ["new", "york"], ["New", "York", "City"], ["the", "the"], [f"é{draw.randrange(9)}"]])
            if draw.random() < 0.1:
                words.append(draw.choice([". x", "a;b", "c\td", "\x0b", "one\nline", "no\x00t", "a\xa0b"]))
        rows.append((500 + k, " ".join(words), draw.choice(["xx", "xx", "yy", None]), "hot", 1))
    return rows


@pytest.mark.parametrize("max_words, block, top", [(3, 1_500_000, 2000), (3, 97, 40), (2, 500, 2000), (4, 300, 2000)])
def test_equal_to_counting_everything(spark, max_words, block, top):
    rows = cases()
    got = collocations.collocations(
        frame(spark, rows), min_count=5, max_words=max_words, top=top, route_words=200, min_routes=7, block_words=block
    )
    assert got.columns == ["grp", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, 5, max_words, top)
    assert len(want) > 20
    assert {tuple(r) for r in got.collect()} == want


def test_slices_do_not_part_phrases(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE_BYTES", 50)
    text = " ".join("a b c d e f g. h i"[: 2 * (k % 9) + 1] for k in range(400))
    tokens = [t for part in collocations.tokens_of(text) for t in part]
    assert tokens == text.replace(".", " . ").encode().split()


def test_hot_words_are_dealt_by_their_followers():
    draw = np.random.default_rng(2)
    names = [b""] + [b"w%d" % k for k in range(400)]
    suffixes = np.stack([np.full(5000, 1), draw.integers(0, 400, 5000), draw.integers(1, 400, 5000)], 1)
    suffixes[suffixes[:, 1] == 0, 2] = 0
    cold = collocations.route_of(names, suffixes, set(), 64)
    spread = collocations.route_of(names, suffixes, {b"w0"}, 64)
    assert len(set(cold)) == 1 and np.bincount(spread).max() < 400
    for second in {*range(400)} - {1}:  # not hot: it ends the words that tell the route
        assert len(set(spread[suffixes[:, 1] == second])) <= 1


def test_sort_abandons_what_cannot_reach_the_count():
    draw = np.random.default_rng(3)
    suffixes = draw.integers(1, 30, (4000, 3))
    weights = draw.integers(1, 4, 4000)
    got = dict(collocations.equal_partitions(suffixes, weights, np.zeros(30, bool), 12))
    want = Counter()
    for s, w in zip(suffixes.tolist(), weights.tolist()):
        for d in (1, 2, 3):
            want[tuple(s[:d])] += w
    assert got == {p: n for p, n in want.items() if n >= 12}


def test_scores_are_exact_beyond_64_bits(spark):
    a = 3_000_000_007
    counts = spark.createDataFrame([("xx", ["p", "q"], 2, a)], "grp string, phrase array<string>, n_words int, f long")
    words = spark.createDataFrame([("xx", "p", a + 5), ("xx", "q", a * 7 + 1)], "grp string, word string, f long")
    got = collocations.cut_scores(counts, words, 1_000_000).first()
    assert (got.l, got.r, got.score) == (a + 5, a * 7 + 1, 1_000_000 * a * a // ((a + 5) * (a * 7 + 1)))


def test_empty_and_null(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0
    rows = [(1, None, None, None, None), (2, "", "xx", None, 0), (3, " .,;", "xx", None, 4)]
    assert collocations.collocations(frame(spark, rows), min_count=1).count() == 0
    clash = frame(spark, [(1, "a b a b", "xx", "s", 1)]).selectExpr("*", "1 as grp", "2 as rank", "3 as f", "4 as route", "5 as phrase")
    got = collocations.collocations(clash, min_count=2).collect()
    assert [tuple(r) for r in got] == [("xx", 1, "a b", 2, 2, 2, 4, 1_000_000)]
