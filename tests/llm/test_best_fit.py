from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from depuse.llm import best_fit as B
from tests.llm.helpers import DOCUMENTS, documents, frame, words


def plainly(lengths, sources, clusters, capacity):
    bins, out = [], []
    for n, s, c in zip(lengths, sources, clusters):
        fits = [(room, k) for k, (room, ss, cc) in enumerate(bins) if room >= n and room > 0 and (s is None or s not in ss) and c not in cc]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append((capacity, set(), set()))
        room, ss, cc = bins[k]
        bins[k] = (room - n, ss | {s}, cc | {c})
        out.append(k)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.sampled_from(["a", "b", "c", None]), st.integers(0, 5)), max_size=40))
def test_the_tightest_compatible_bin_is_taken(pieces):
    pieces.sort(key=lambda p: -p[0])
    lengths, sources, clusters = [list(c) for c in zip(*pieces)] or ([], [], []) if pieces else ([], [], [])
    assert B.best_fit(lengths, sources, clusters, 20) == plainly(lengths, sources, clusters, 20)


def check(rows, got, capacity):
    """Every word is in one piece; bins keep capacity and conflicts."""
    texts = Counter((i, " ".join(words(t))) for i, t, *_ in rows)
    bins, whole = defaultdict(list), defaultdict(list)
    for r in got:
        if r.n_words:
            bins[r.bin_id].append(r)
            assert words(r.text) and len(words(r.text)) == r.n_words
        else:
            assert r.bin_id is None
        whole[r.doc_id, r.text_hash].append(r)
    for group in bins.values():
        assert sum(r.n_words for r in group) <= capacity
        assert len({r.cluster for r in group}) == len(group)
        named = [r.source for r in group if r.source is not None]
        assert len(set(named)) == len(named)
        assert sorted(r.place for r in group) == list(range(len(group)))
    found = Counter()
    for (i, _), pieces in whole.items():
        first = [r for r in pieces if r.piece == 0]
        text = " ".join(" ".join(words(next(p.text for p in pieces if p.piece == k))) for k in range(1 + max(p.piece for p in pieces)))
        found[i, text] += len(first)
    assert found == texts


def test_documents_with_every_case(spark):
    rows = documents(n=120)
    docs = frame(spark, rows)
    for size in (25, 10_000):
        check(rows, B.pack(docs, 100, size).collect(), 100)
    one, two = B.pack(docs, 100, 25), B.pack(docs, 100, 25, with_text=False)
    assert Counter(tuple(r)[:-1] for r in one.collect()) == Counter(tuple(r)[:-1] for r in two.collect())


def test_clusters_of_the_caller_share_no_bin(spark):
    """Parts of one document, and near copies under one component, stay apart
    though their texts differ and no source parts them; a null cluster is the
    text itself."""
    rows = [(k // 4, f"part {k} of a text", "xx", None, 1) for k in range(80)]
    rows += [(None, "nobody's text", "xx", None, 1)] * 3
    docs = frame(spark, rows)
    got = B.pack(docs, 100, cluster=F.col("doc_id")).collect()
    check(rows, got, 100)
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r.doc_id if r.doc_id is not None else "nobody")
    assert all(len(set(b)) == len(b) for b in bins.values())
    assert len({r.bin_id for r in got if r.doc_id == 0}) == 4
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, B.pack(docs, 100, cluster=F.col("doc_id")).collect()), key=str)
    plain = B.pack(docs, 100).collect()
    assert any(n > 1 for n in Counter((r.bin_id, r.doc_id) for r in plain).values())  # what the cluster is for


def test_empty_table(spark):
    assert B.pack(spark.createDataFrame([], DOCUMENTS)).count() == 0
