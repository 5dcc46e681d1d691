import numpy as np
import pytest
from pyspark.sql import functions as F

from depuse.llm import vafile

SCHEMA = "vec_id long, embedding array<float>, label int, rank int"


def brute(rows, top, every):
    best = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            ints = [int(np.floor(256 * float(np.float32(x)))) for x in v]
            best[i] = min(best.get(i, ints), ints)
    out = set()
    for q in best:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(best[q], v)), i) for i, v in best.items() if i != q and len(v) == len(best[q]))
            out |= {(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(scored[:top])}
    return out


def cases(seed=1):
    draw = np.random.default_rng(seed)
    rows = [(int(k), [float(x) for x in v]) for k, v in enumerate(draw.normal(size=(300, 8)))]
    rows += [(k, rows[7][1]) for k in range(300, 400)]  # one very common vector
    rows += [(400, None), (401, []), (402, [1.0, None]), (403, [float("nan")] * 8), (404, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(405, [0.5, 2.0]), (410, [1.5, -1.0]), (420, [1.0]), rows[10], (10, rows[11][1]), (0, [0.0] * 8)]
    return rows


@pytest.mark.parametrize("sizes", [(10_000, 10_000), (50, 7)])
def test_top_k_is_exact(spark, sizes):
    rows = cases()
    df = spark.createDataFrame([(i, v, 0, 9) for i, v in rows], SCHEMA)
    got = vafile.search(vafile.integer_vectors(df), F.col("vec_id") % 10 == 0, 5, 4, *sizes)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert {tuple(r) for r in got.collect()} == brute(rows, 5, 10)


def test_huge_components_and_empty_table(spark):
    rows = [(0, [1e30, 1.0]), (10, [-1e30, 2.0]), (20, [3.0, 4.0])]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA)
    got = vafile.search(vafile.integer_vectors(df), F.col("vec_id") % 10 == 0)
    assert got.filter("query_id = 20").orderBy("rank").first().score == 2**63 - 1
    assert got.count() == 6
    assert vafile.search(vafile.integer_vectors(df.limit(0)), F.col("vec_id") % 10 == 0).count() == 0


def test_cells_bound_and_spare_reads():
    draw = np.random.default_rng(3)
    vectors = draw.integers(-100, 100, (4000, 16))
    lower, upper = vafile.Cells(vectors, 5).edges()
    assert (lower <= vectors).all() and (vectors <= upper).all()
    read = []
    vafile.top_of_shard(np.arange(5), vectors[:5], np.arange(4000), vectors, reads=read.append)
    assert max(read) < 1000
