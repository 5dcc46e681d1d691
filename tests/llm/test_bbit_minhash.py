import random
from collections import Counter, defaultdict

import numpy as np

from depuse.llm import bbit_minhash as M
from depuse.llm.components import components
from tests.llm.helpers import DOCUMENTS, documents, frame, sentence, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    """{(id, text): (set size, component)} over rows with ids and words."""
    sets = {(i, t): shingles(t) for i, t, *_ in rows if i is not None}
    keys = sorted(k for k, s in sets.items() if s)
    parent = {k: k for k in keys}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    inside = defaultdict(list)
    for k in keys:
        for s in sets[k]:
            inside[s].append(k)
    common = Counter((a, b) for group in inside.values() for n, b in enumerate(group) for a in group[:n])
    for (a, b), c in common.items():
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    return {k: (len(s), top(k)[0] if s else k[0]) for k, s in sets.items()}


def near_copies(draw, n, length, changes):
    base = sentence(draw, length, 5000).split(" ")
    for _ in range(n):
        w = list(base)
        for _ in range(draw.randrange(changes + 1)):
            w[draw.randrange(length)] = f"new{draw.randrange(10**6)}"
        yield " ".join(w)


def agree(spark, rows):
    docs = frame(spark, rows)
    got = M.near_duplicates(docs)
    told = brute(rows)
    found = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()]
    expected = [
        (i, *told[i, t], told[i, t][1] == i) if i is not None else (None, len(shingles(t)), None, True) for i, t, *_ in rows
    ]
    assert Counter(found) == Counter(expected)
    return docs


def test_every_case_agrees_with_brute_force(spark):
    draw = random.Random(8)
    rows = documents(n=60)
    near = [(1000 + k, t, "xx", "a", 1) for k, t in enumerate(near_copies(draw, 60, 120, 5))]
    short = [(2000 + k, t, "xx", "a", 1) for k, t in enumerate(["A b c", "a B c", "a b c d", "a b c d e", "a b c d e f", "é", "É"])]
    docs = agree(spark, rows + near + short)
    kept = M.one_of_each(docs)
    assert kept.columns == docs.columns
    told = brute(rows + near + short)
    ids = [r.doc_id for r in kept.collect()]
    assert Counter(i for i in ids if i is not None) == Counter(i for (i, _), (_, c) in told.items() if c == i)


def test_chains_of_near_copies_are_one_component(spark):
    """Neighbours are alike, the ends are not: hubs alone would miss links."""
    draw = random.Random(2)
    w = sentence(draw, 200, 5000).split(" ")
    rows = []
    for k in range(30):
        rows.append((k * 7 % 31, " ".join(w), "xx", "a", 1))
        at = draw.randrange(190)
        w[at:at + 6] = [f"n{draw.randrange(10**6)}" for _ in range(6)]
    agree(spark, rows)


def test_estimate_follows_similarity(spark):
    draw = random.Random(1)
    texts = list(near_copies(draw, 12, 400, 25))
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    s = M.sketch(rows).select("doc_id", "signature")
    sets = [shingles(t) for t in texts]
    a, b = s.selectExpr("signature as sa", "doc_id as a"), s.selectExpr("signature as sb", "doc_id as b")
    links = spark.createDataFrame([(0, k) for k in range(12)], "a long, b long")
    for r in links.join(a, "a").join(b, "b").select("b", M.estimate(a["sa"], b["sb"]).alias("e")).collect():
        exact = len(sets[0] & sets[r.b]) / len(sets[0] | sets[r.b])
        assert abs(r.e - exact) < 0.15


def test_components_agree_with_brute_force(spark):
    draw = random.Random(6)
    links = [(draw.randrange(80), draw.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 140)]
    least = {k: k for pair in links for k in pair}
    for _ in range(200):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    alone = {a for a, b in links if a == b} - {k for a, b in links if a != b for k in (a, b)}
    assert got == {k: v for k, v in least.items() if k not in alone}


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCUMENTS)
    assert M.near_duplicates(empty).count() == 0 and M.one_of_each(empty).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id long, text string")
    assert {tuple(r)[2:] for r in M.near_duplicates(blank).collect()} == {(0, 1, True), (0, 2, True), (0, 3, True)}


def test_signatures_hold_low_bits_of_minima():
    sets = [np.unique(np.random.default_rng(k).integers(0, 2**63, 30, dtype=np.uint64)) for k in range(4)]
    packed = M.signatures(sets)
    for k, s in enumerate(sets):
        x = (s >> np.uint64(32)).astype(np.uint64)
        for n in (0, 7, 239):
            least = int(((x * int(M._FACTORS[n]) + int(M._SHIFTS[n])) % 2**32).min())
            assert (int(packed[k, n // 5]) >> (8 * (n % 5))) & 255 == least & 255
