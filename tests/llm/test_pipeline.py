"""The stages against plain readings of what each must do to its input."""

from collections import Counter

import pytest

import corpus_pipeline as P
from depuse.llm import surrogates
from depuse.llm.apportion import capped_targets
from depuse.llm.staging import stage
from tests.llm.helpers import words
from tests.llm.test_bbit_minhash import brute
from tests.llm.test_best_fit import check
from tests.llm.test_crf_lines import base

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, function in P.STAGES:
        out.append(stage(function(spark, out[-1], SF)))
    return [d.collect() for d in out], [d.columns for d in out]


def test_stages_are_in_order_and_keep_the_columns(steps):
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "pii", "mixing", "packing"]
    assert all(c == steps[1][0] for c in steps[1][:-1])


def test_quality_drops_only_rejects(steps, spark):
    before, after = steps[0][0], {r.doc_id for r in steps[0][1]}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 1}
    for r in before:
        failed = base(r.text)[5]
        assert not (failed and r.doc_id in after)
        assert r.doc_id in after or failed or r.doc_id not in good
    assert Counter(steps[0][1]) <= Counter(before)


def test_one_document_of_each_group_stays(steps):
    rows = [tuple(r) for r in steps[0][1]]
    told = brute(rows)
    assert sorted(r.doc_id for r in steps[0][2]) == sorted({c for _, c in told.values()})


def test_entities_are_replaced_and_the_rest_stays(steps):
    before = {r.doc_id: r.text for r in steps[0][2]}
    assert len(steps[0][3]) == len(before)
    for r in steps[0][3]:
        found = surrogates.entities(before[r.doc_id])
        assert (r.text == before[r.doc_id]) == (not found) and r.n_chars == len(r.text)
        assert not any(before[r.doc_id][a:b] in r.text for a, b, *_ in found)


def test_the_mix_meets_its_targets(steps):
    before, after = steps[0][3], steps[0][4]
    sizes, taken, texts = Counter(), Counter(), {}
    for r in before:
        sizes[r.source] += len(words(r.text))
        texts[r.doc_id] = r.text
    for r in after:
        taken[r.source] += len(words(r.text))
        assert r.text in texts[r.doc_id]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = capped_targets([sizes[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5, 2)
    assert all(abs(taken[s] - t) <= 2 * 128 for s, t in zip(names, targets))


def test_packing_places_every_word(steps):
    check([(r.doc_id, r.text) for r in steps[0][4]], steps[0][5], 1024)


def test_run_gives_the_last_stage(spark, steps):
    got = P.run(spark, SF)
    assert got.columns == steps[1][-1] and got.count() == len(steps[0][5])
