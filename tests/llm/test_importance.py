import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from depuse.llm import importance
from tests.llm.helpers import documents, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TARGET = [(1, "W1x w2x, w3x! Über 1234"), (2, None), (3, ""), (4, "w1x w1x\nw5x é-É")]


def features(text, max_n, buckets):
    words = WORD.findall((text or "").translate(FOLD))
    runs = [" ".join(words[i:i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


def brute(rows, target, max_n=1, buckets=10_000, min_words=20, percent=10):
    found = [(d, *features(t, max_n, buckets)) for d, t, *_ in rows]
    s, t = Counter(b for *_, f in found for b in f), Counter(b for _, x in target for b in features(x, max_n, buckets)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for d, n, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    pool = sorted((-r[4], r[0] is not None, r[0] or 0) for r in out if r[1] >= min_words)
    drawn = Counter(pool[: percent * len(pool) // 100])
    return Counter(tuple(r) for r in out), drawn


def check(got, rows, target, **how):
    want, drawn = brute(rows, target, **how)
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == want
    ranked = sorted((r.rank, r) for r in got if r.rank is not None)
    assert [k for k, _ in ranked] == list(range(1, sum(drawn.values()) + 1))
    assert [(-r.score, r.doc_id is not None, r.doc_id or 0) for _, r in ranked] == sorted(drawn.elements())


def cases(seed=0):
    rows = documents(seed, 90)
    rows += [(700 + k, "One very common line of w1x and w2x\n" * 9 + f"w{k}x w{k}x\n\nend of it", "xx", "s", 1) for k in range(40)]
    rows += [(None, "null id " * 30, None, None, None)] * 5
    return rows


@pytest.mark.parametrize("how, range_rows", [({}, 250_000), ({"percent": 60, "min_words": 5}, 7), ({"max_n": 3, "buckets": 300}, 20)])
def test_equal_to_counting_everything(spark, how, range_rows):
    rows = cases()
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    got = importance.resample(frame(spark, rows), target, range_rows=range_rows, **how)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    check(got.collect(), rows, TARGET, **how)


@pytest.mark.parametrize("max_n", [2, 3, 4])
def test_runs_over_lines(max_n):
    text = "a b c d e f g h\n\nB\nc d\na b c d e f g\nx"
    whole = Counter(features(text, max_n, 1 << 30)[1])
    inside = Counter(b for line in text.split("\n") for b in features(line, max_n, 1 << 30)[1])
    over = Counter(zlib.crc32(b" ".join(r)) % (1 << 30) for r in importance.spanning(text.encode().split(b"\n"), max_n))
    assert whole == inside + over


def test_lines_are_hashed_once(spark):
    rows = frame(spark, [(k, "same line\nand  more", "xx", "s", 1) for k in range(50)]).select("text")
    lines = importance.line_features(rows, "text", 10_000, 1).collect()
    assert sorted((r.times, r.n_words) for r in lines) == [(50, 2), (50, 2)]


def test_empty_tables_and_clashing_names(spark):
    empty, target = frame(spark, []), spark.createDataFrame(TARGET, "item_id long, text string")
    assert importance.resample(empty, target).count() == 0
    rows = [(k, f"w{k}x " * 25, "xx", "s", 1) for k in range(20)]
    clash = frame(spark, rows).selectExpr("*", "1 as uid", "2 as line", "3 as gain", "4 as rank", "5 as _salt")
    check(importance.resample(clash, target.limit(0)).collect(), rows, [])
