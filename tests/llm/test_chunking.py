import random
from collections import Counter

import numpy as np

from depuse.llm import chunking as C
from depuse.llm.words import WordHashes, words_of
from tests.llm.helpers import documents, frame, sentence, words


def chunked(text):
    gears = WordHashes().of(words_of(text))
    return np.append(C.cuts(gears, np.array([0])), len(gears)).tolist() if len(gears) else [0]


def test_gear_hash_is_the_rolling_one():
    gears = np.random.default_rng(0).integers(0, 2**63, 50, dtype=np.uint64)
    h, rolled = 0, []
    for g in gears.tolist():
        h = ((h << 16) + g) % 2**64
        rolled.append(h)
    assert C.gear_hashes(gears).tolist() == C.mixed(np.array(rolled, np.uint64)).tolist()


def test_insertions_move_only_cuts_beside_them():
    text = sentence(random.Random(4), 600)
    w = text.split(" ")
    before = chunked(text)
    after = chunked(" ".join(w[:200] + ["new", "words"] + w[200:]))
    assert [c for c in before if c < 190] == [c for c in after if c < 190]
    assert [c for c in before if c > 220] == [c - 2 for c in after if c > 222]
    assert 5 < 600 / len(before) < 10


def test_documents_do_not_change_each_others_cuts():
    texts = [sentence(random.Random(k), 5 + 30 * k) for k in range(8)]
    gears = [WordHashes().of(words_of(t)) for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(g) for g in gears])[:-1]))
    together = C.cuts(np.concatenate(gears), starts)
    alone = [c + s for t, s in zip(texts, starts) for c in chunked(t)[:-1]]
    assert together.tolist() == alone


def brute(rows):
    """The same decisions with chunks as word tuples."""
    docs = {(i is None, i, t) for i, t in rows}
    found = {}
    parts = {}
    for null, i, t in docs:
        w, c = words_of(t), chunked(t)
        parts[i, t] = [(a, b - a, tuple(w[a:b])) for a, b in zip(c, c[1:])]
    import xxhash  # places of one text order by the engine's own text hash only between equal ids

    for (i, t), chunks in parts.items():
        for place, _, key in chunks:
            found.setdefault(key, set()).add((i is None, i if i is not None else 0, t, place))
    return parts, found


def test_repeated_passages_go_and_first_ones_stay(spark):
    draw = random.Random(9)
    passage = sentence(draw, 60)
    rows = [(i, t) for i, t, *_ in documents(n=40)]
    rows += [(200 + k, f"{sentence(draw, 30)} {passage} {sentence(draw, 30)}") for k in range(30)]
    rows += [(300, sentence(draw, 200)), (301, "same " * 500), (302, "same " * 500)]
    docs = frame(spark, rows, "doc_id long, text string")
    got = C.dedupe_passages(docs)
    assert got.columns == ["doc_id", "text", "n_words", "dup_words", "dup_spans"]
    out = {(r.doc_id, r.n_words, r.dup_words): r for r in got.collect()}
    result = got.collect()
    assert len(result) == len(rows)
    by_id = {r.doc_id: r for r in result if r.doc_id is not None}
    texts = dict(rows)
    assert by_id[200].dup_words == 0 and by_id[300].text == texts[300]
    for k in range(201, 230):
        assert by_id[k].dup_words >= 40 and words(by_id[k].text)[:30] == words(texts[k])[:30]
        assert words(by_id[k].text)[-30:] == words(texts[k])[-30:]
    assert by_id[301].dup_words == 0 and by_id[302].text == "" and by_id[302].dup_words == 500
    assert by_id[3].text.split() == [] or by_id[3].dup_words == len(words(texts[3])) or len(words(texts[3])) < C.MIN_RUN
    for r in result:
        assert len(words(r.text)) == r.n_words - r.dup_words
    assert Counter(r.text for r in result if r.n_words == 0) == Counter(t for _, t in rows if not words(t))
    assert out


def test_spans_agree_with_brute_force(spark):
    rows = [(i, t) for i, t, *_ in documents(seed=2, n=50) if i is not None]
    parts, found = brute(rows)
    spans = {(r.doc_id, len(r.spans)) for r in C.repeated_spans(frame(spark, rows, "doc_id long, text string")).collect()}
    expected = set()
    for (i, t), chunks in parts.items():
        again = 0
        for place, _, key in chunks:
            least = min((x[1], x[3]) for x in found[key] if x[1] == min(y[1] for y in found[key]))
            again += len(found[key]) > 1 and (i, place) != least
        if again:
            expected.add((i, again))
    once = Counter(i for i, _ in {(i, t) for i, t in rows})
    alone = {i for i, n in once.items() if n == 1}
    assert {s for s in spans if s[0] in alone} == {e for e in expected if e[0] in alone}


def test_common_phrases_in_unrelated_documents_stay(spark):
    """Chunks repeat everywhere, but a cut passage occurs elsewhere as a whole."""
    draw = random.Random(5)
    phrases = [sentence(draw, 12, 10_000) for _ in range(40)]
    rows = [(k, " ".join(f"{' '.join(draw.choice(phrases).split(' ')[:draw.randrange(6, 13)])}" for _ in range(12))) for k in range(150)]
    passage = sentence(draw, 60, 10_000)
    rows += [(500 + k, f"{sentence(draw, 20)} {passage} {sentence(draw, 20)}") for k in range(3)]
    texts = dict(rows)
    windows = Counter(tuple(w[a:a + C.MIN_RUN]) for w in map(words, texts.values()) for a in range(len(w) - C.MIN_RUN + 1))
    result = C.dedupe_passages(frame(spark, rows, "doc_id long, text string")).collect()
    assert sum(r.dup_words for r in result) > 80
    for r in result:
        w = words(texts[r.doc_id])
        for place, n in r.dup_spans:
            covered = {
                a + k for a in range(place, place + n - C.MIN_RUN + 1) if windows[tuple(w[a:a + C.MIN_RUN])] > 1
                for k in range(C.MIN_RUN)
            }
            assert covered == set(range(place, place + n))
    by_id = {r.doc_id: r for r in result}
    assert by_id[500].dup_words == 0 and min(by_id[501].dup_words, by_id[502].dup_words) >= 40


def test_stretches_are_the_shortest_of_whole_chunks():
    draw = random.Random(6)
    for _ in range(50):
        sizes = [draw.randrange(1, 60) for _ in range(4)]
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        firsts = np.array(sorted({*starts.tolist(), *draw.sample(range(sum(sizes)), min(8, sum(sizes)))}))
        expected = set()
        for a, n in zip(starts, sizes):
            edges = [f for f in firsts if a <= f < a + n] + [a + n]
            spans = [(x, y) for i, x in enumerate(edges) for y in edges[i + 1:] if y - x >= 12]
            expected |= {(x, min(y for b, y in spans if b == x)) for x, _ in spans}
            expected |= {(max(b for b, e in spans if e == y), y) for _, y in spans}
        begins, ends = C.stretches(firsts, starts, sum(sizes), 12)
        assert set(zip(begins.tolist(), ends.tolist())) == {(int(a), int(b)) for a, b in expected}
        assert set(zip(*(x.tolist() for x in C.stretches(firsts, starts, sum(sizes), 1)))) == set(zip(firsts.tolist(), [*firsts[1:].tolist(), sum(sizes)]))


def test_digests_tell_sequences_apart_by_two_numbers():
    """Equal stretches have equal digests wherever they stand, and either
    number alone differs between all others."""
    draw = np.random.default_rng(1)
    gears = draw.integers(0, 2**63, 4000, dtype=np.uint64)
    gears[2000:] = gears[:2000]
    begins = draw.integers(0, 1900, 5000)
    ends = begins + draw.integers(1, 100, 5000)
    one, other = C.digests(gears, begins, ends), C.digests(gears, begins + 2000, ends + 2000)
    assert all((a == b).all() for a, b in zip(one, other))
    spans = len(set(zip(begins.tolist(), ends.tolist())))
    assert one[0].dtype == np.int64 and one[1].dtype == np.int32
    assert len(set(one[0].tolist())) == len(set(one[1].tolist())) == spans
    swapped = np.array([gears[1], gears[0]])
    for a, b in zip(C.digests(swapped, np.array([0]), np.array([2])), C.digests(gears, np.array([0]), np.array([2]))):
        assert a != b


def brute_cut(rows):
    """What is cut, by comparing the word tuples of the stretches themselves."""
    texts = dict(rows)
    first, found = {}, {}
    for i in sorted(texts):
        w = words_of(texts[i])
        c = chunked(texts[i])
        begins, ends = C.stretches(np.array(c[:-1]), np.array([0]), len(w), C.MIN_RUN) if w else ((), ())
        found[i] = [(int(a), int(b), tuple(w[a:b])) for a, b in zip(begins, ends)]
        for a, _, key in found[i]:
            first[key] = min(first.get(key, (i, a)), (i, a))
    return {i: {p for a, b, key in spans if first[key] != (i, a) for p in range(a, b)} for i, spans in found.items()}


def test_cut_words_agree_with_brute_force_over_stretches(spark):
    draw = random.Random(12)
    passages = [sentence(draw, draw.randrange(14, 90), 3000) for _ in range(12)]
    rows = []
    for k in range(160):
        parts = [draw.choice(passages) if draw.random() < 0.4 else sentence(draw, draw.randrange(1, 40), 3000) for _ in range(5)]
        rows.append((k, draw.choice([" ", "\n"]).join(parts)))
    rows += [(200 + k, passages[k % 3]) for k in range(9)]
    want = brute_cut(rows)
    assert sum(map(len, want.values())) > 2000
    for r in C.dedupe_passages(frame(spark, rows, "doc_id long, text string")).collect():
        assert {p for a, n in r.dup_spans for p in range(a, a + n)} == want[r.doc_id]


def test_empty_table(spark):
    assert C.dedupe_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
