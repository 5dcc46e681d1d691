import itertools
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from depuse.llm import hilbert
from tests.llm.helpers import DOCUMENTS, documents, frame


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (2, 1), (4, 2)])
def test_curve_visits_neighbours(spark, dims, bits):
    names = [f"d{k}" for k in range(dims)]
    cells = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=dims)), ", ".join(f"{n} int" for n in names))
    path = [tuple(r)[:dims] for r in hilbert.with_curve(cells, names, bits).orderBy("curve_index").collect()]
    places = sorted(r.curve_index for r in hilbert.with_curve(cells, names, bits).collect())
    assert places == list(range((1 << bits) ** dims))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(path, path[1:]))


def sharded(spark, rows, shards):
    docs = frame(spark, rows)
    keep = {"doc_id": F.col("doc_id"), "size": hilbert.size_of(F.col("text")), "text_crc32": hilbert.crc_of(F.col("text"))}
    return hilbert.hilbert_shards(docs, shards, keep)


@pytest.mark.parametrize("shards", [1, 7, 24, 100])
def test_shards_are_even_runs_of_the_curve(spark, shards):
    rows = documents()
    got = sharded(spark, rows, shards).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        (i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    counts = Counter(r.shard for r in got)
    full = [counts.get(s, 0) for s in range(shards)]
    assert max(full) - min(full) <= 1 and sum(full) == len(rows)
    by_place = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.slot for r in by_place] == [k for s in range(shards) for k in range(counts.get(s, 0))]
    assert [r.curve_index for r in by_place] == sorted(r.curve_index for r in got)


def test_reruns_agree_and_no_python_is_planned(spark):
    rows = documents(3)
    one, two = sharded(spark, rows, 5), sharded(spark, rows, 5)
    assert Counter(map(tuple, one.collect())) == Counter(map(tuple, two.collect()))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_files_prune(spark, tmp_dir):
    docs = frame(spark, documents(5, 300))
    out = hilbert.hilbert_shards(docs, 12, {c: F.col(c) for c in docs.columns})
    hilbert.write_shards(out, f"{tmp_dir}/sharded", 12)
    back = spark.read.parquet(f"{tmp_dir}/sharded")
    assert back.count() == docs.count()
    manifest = hilbert.shard_manifest(out, ["lang_cell", "source_cell", "size_cell"])
    cell = docs.limit(1).select(hilbert.category_cell(F.lit("xx"))).first()[0]
    opened = {r.shard for r in hilbert.prune(manifest, {"lang_cell": cell}).collect()}
    assert {r.shard for r in back.filter("lang = 'xx'").select("shard").distinct().collect()} <= opened
    assert len(opened) < 12


def test_empty_table(spark):
    assert sharded(spark, documents(), 24).schema is not None
    empty = spark.createDataFrame([], DOCUMENTS)
    assert hilbert.hilbert_shards(empty, 24, {"doc_id": F.col("doc_id")}).count() == 0
