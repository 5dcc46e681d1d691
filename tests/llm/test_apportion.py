from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from depuse.llm import apportion as A
from tests.llm.helpers import DOCUMENTS, documents, frame, words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.integers(0, 40)), min_size=1, max_size=8), st.integers(0, 120))
def test_seats_go_one_by_one_to_the_highest_quotient(parties, seats):
    votes, limits = [float(v) for v, _ in parties], [m for _, m in parties]
    expected = [0] * len(votes)
    for _ in range(seats):
        open_ = [s for s in range(len(votes)) if expected[s] < limits[s] and votes[s] > 0]
        if not open_:
            break
        best = max(open_, key=lambda s: (Fraction(int(votes[s])) / (2 * expected[s] + 1), -s))
        expected[best] += 1
    assert A.sainte_lague(votes, seats, limits) == expected


def test_targets_stop_at_twice_the_size():
    sizes, weights = [1000, 10, 500, 0, 300], [5, 2, 1, 5, 2]
    t = A.capped_targets(sizes, weights, 1.5, 2)
    assert sum(t) == pytest.approx(1.5 * sum(sizes)) and all(x <= 2 * n for x, n in zip(t, sizes))
    free = [(x / w) for x, w, n in zip(t, weights, sizes) if x < 2 * n]
    assert max(free) == pytest.approx(min(free))
    assert A.capped_targets([], [], 1.5, 2) == [] and A.capped_targets([0], [5], 1.5, 2) == [0]


def mixed(spark, rows, **options):
    return A.apportion(frame(spark, rows), **options).select("doc_id", "size", "source_size", "target", "taken")


@pytest.mark.parametrize("block", [1, 16, 128])
def test_sources_come_near_their_targets(spark, block):
    rows = documents(n=150)
    got = mixed(spark, rows, block_words=block).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(words(t))) for i, t, *_ in rows)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = A.capped_targets([sizes[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5, 2)
    assert {(r.source_size, r.target) for r in got} == {(sizes[s], t) for s, t in zip(names, targets)}
    taken = defaultdict(int)
    for r in got:
        taken[r.source_size] += r.taken
    for s, t in zip(names, targets):
        assert abs(taken[sizes[s]] - t) <= 2 * block
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixed(spark, rows, block_words=block).collect()))


def test_the_mix_holds_the_words_taken(spark):
    rows = [r for r in documents(n=80) if r[0] is None or r[0] not in (1, 2)]
    docs = frame(spark, rows)
    plan = {r.doc_id: r for r in A.apportion(docs, block_words=16).collect() if r.doc_id is not None}
    parts = A.mix_documents(docs, block_words=16)
    assert parts.columns == docs.columns
    texts = {i: t for i, t, *_ in rows}
    held = Counter()
    for r in parts.collect():
        assert r.n_chars == len(r.text)
        if r.doc_id is not None:
            held[r.doc_id] += len(words(r.text))
            assert r.text in texts[r.doc_id]
    assert held == Counter({i: r.taken for i, r in plan.items() if r.taken})


def test_clashing_column_names_are_kept(spark):
    schema = DOCUMENTS + ", size string, taken int, target string, _size string, _c0 int"
    docs = frame(spark, [(*r, "s", 1, "t", "u", 2) for r in documents(n=30)], schema)
    parts = A.mix_documents(docs, block_words=16)
    assert parts.columns == docs.columns and parts.schema == docs.schema
    assert {tuple(r)[5:] for r in parts.collect()} == {("s", 1, "t", "u", 2)}
    sized = A.apportion(docs, ["doc_id", "size"], block_words=16).select("doc_id", "size").collect()
    assert Counter(map(tuple, sized)) == Counter((i, len(words(t))) for i, t, *_ in documents(n=30))


def test_shard_quotas_add_up(spark):
    plan = A.block_plan([5000, 100, 9000, 40], block_words=16, shards=7)
    ends = [row[-1] for row in plan]
    totals = [sum(e[k] for e in ends) for k in range(7)]
    awards = round(sum(row[2] for row in plan) / 16)
    assert totals == [awards * (k + 1) // 7 for k in range(7)]
    assert all(a <= b for e in ends for a, b in zip(e, e[1:])) and [row[6] for row in plan] == [e[-1] for e in ends]


def test_empty_table_and_too_many_sources(spark, monkeypatch):
    empty = spark.createDataFrame([], DOCUMENTS)
    assert A.apportion(empty).count() == 0 and A.mix_documents(empty).count() == 0
    monkeypatch.setattr(A, "MAX_SOURCES", 2)
    with pytest.raises(ValueError):
        A.apportion(frame(spark, documents()))


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 900), st.integers(0, 1800), st.integers(1, 130), st.integers(0, 40), st.integers(1, 500), st.integers(0, 500))
def test_settled_to_the_word(size, want, width, quota, step, start):
    blocks, want = -(-size // width), min(want, 2 * size)
    step = next(s for s in range(step, step + 1000) if A.math.gcd(s, blocks) == 1)
    start, quota = start % blocks, min(quota, 2 * blocks)
    whole, block, part = A.settled(size, want, blocks, quota, step, start, width)
    real = [min(width, size - b * width) for b in range(blocks)]
    order = sorted(range(blocks), key=lambda b: (b * step + start) % blocks)
    picks = (order * 3)[: whole + 1]
    assert sum(real[b] for b in picks[:whole]) + part == want
    assert picks[whole] == block and 0 <= part < real[block]


def test_no_source_vanishes(spark):
    """A thousand sources of 1 to 300 words beside one of 20,000."""
    rows = [(k, "w " * (1 + k * 7 % 300), "xx", f"s{k:04d}", 1) for k in range(1000)]
    rows += [(1000 + k, "big " * 400, "xx", "t", 1) for k in range(50)]
    sizes = {r[3]: 0 for r in rows}
    for _, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    targets = A.capped_targets([sizes[s] for s in sorted(sizes)], [(5, 2, 1)[k % 3] for k in range(len(sizes))], 1.5, 2)
    docs = frame(spark, rows)
    got = A.apportion(docs, ["doc_id", "source"]).collect()
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert taken == Counter({s: min(round(t), 2 * sizes[s]) for s, t in zip(sorted(sizes), targets)})
    held = Counter()
    for r in A.mix_documents(docs).collect():
        held[r.doc_id] += len(words(r.text))
    assert held == Counter({r.doc_id: r.taken for r in got if r.taken})
