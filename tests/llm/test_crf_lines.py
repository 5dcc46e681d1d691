import itertools
from collections import Counter

import numpy as np

from depuse.llm import crf_lines as C
from tests.llm.helpers import documents, frame, words

ODD = ["", "\n", "a\n\nb \n", "x y z\nx y z\n x y z\n", "a|b # c\x0bd\x0ce\rf", "é " * 30, "one two " * 50, "  word\u0085next", "w " * 9 + "\n" + "w " * 9]


def base(text):
    w = words(text)
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(8)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), again, len(covered), failed


def test_base_counts_agree_with_brute_force():
    texts = [t or "" for _, t, *_ in documents(n=80)] + ODD
    got, *_ = C.measure(texts)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(int(got[n][k]) for n in names) for k in range(len(texts))] == [base(t)[:5] for t in texts]


def test_viterbi_finds_the_best_sequence():
    draw = np.random.default_rng(5)
    for n in range(1, 8):
        scores, t = draw.normal(size=n).tolist(), draw.normal(size=(2, 2)).tolist()
        value = lambda y: sum(s for s, v in zip(scores, y) if v) + sum(t[a][b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert tuple(map(int, C.viterbi(scores, t))) == best
    assert C.viterbi([], [[0, 0], [0, 0]]) in ([], [True])


def test_training_separates_labelled_lines():
    clean, junk = 1 << 0 | 1 << 10, 1 << 0 | 1 << 3
    sequences = [(np.array([clean] * 6 + [junk]), 1), (np.array([junk] * 5 + [clean]), 0)] * 20
    w, t = C.train(sequences)
    assert (C._features(np.array([clean])) @ w)[0] > 0 > (C._features(np.array([junk])) @ w)[0]
    assert t[0, 0] > t[0, 1] and t[1, 1] > t[1, 0]


def test_held_out_accuracy_and_base_rules(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train = labels.filter("doc_id % 2 = 0")
    told = {r.doc_id: r.quality for r in labels.filter("doc_id % 2 = 1").collect() if r.quality is not None}
    got = C.label_quality(docs, train, ["doc_id"]).collect()
    fair = [(r.kept, told[r.doc_id]) for r in got if r.doc_id in told and not r.base_failed]
    assert np.mean([k == bool(q) for k, q in fair]) > 0.97
    assert np.mean([k for k, q in fair if q]) > 0.98


def test_documents_with_every_case(spark):
    rows = documents()
    docs = frame(spark, [(*r, True) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept boolean")
    got = C.label_quality(docs)
    assert got.columns[:5] == docs.columns[:5]
    assert Counter((r.doc_id, r.text, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.collect()) == Counter(
        (i, t, *base(t)) for i, t, *_ in rows
    )
    assert not any(r.kept and r.base_failed for r in got.collect())
    empty = frame(spark, [(1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert C.label_quality(docs.limit(0), empty).count() == 0
    assert C.label_quality(docs, empty, ["doc_id"]).count() == len(rows)


def test_the_sample_is_bounded_in_rows_and_lines(spark):
    docs = frame(spark, [(1, "a line\n" * 5000, None, None, 1)] * 40 + [(2, "## |\n" * 3, None, None, 1)])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    found = C.training_sample(docs, labels, per_document=700)
    assert sorted((len(bits), y) for bits, y in found) == [(4, 0), (700, 1)]
    assert C._spread(np.arange(10), 4).tolist() == [0, 2, 5, 7]
