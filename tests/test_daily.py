import random

import pytest

from depuse.functions.time import MILLIS_PER_DAY
from depuse.operators import daily as U
from depuse.operators import report as R
from depuse.plans import jobs
from tests.conftest import rows
from tests.test_report import SCHEMA, enhanced

# ids at the borders of blocks, negative ones, and the ends of the type
CLIENTS = [0, 1, -1, 32_767, 32_768, 32_769, -32_767, -32_768, -32_769, 2**31 - 1, -(2**31), *range(100, 160)]


def sample(spark, seed=3, n=900):
    draw = random.Random(seed)
    data = []
    for k in range(n):
        gavs = draw.sample(["a", "b", "c", "d", "rare"], draw.choice([1, 2, 3])) + ["everyone"]
        dependencies = draw.sample(gavs, draw.randrange(len(gavs)))
        day = draw.randrange(5)
        data.append((draw.choice(CLIENTS), k, day * MILLIS_PER_DAY + draw.randrange(MILLIS_PER_DAY), gavs, dependencies))
    return data


@pytest.mark.parametrize("few", [0, 2, 20, U.SPARSE_UP_TO])
def test_every_range_of_days_agrees_with_sets(spark, few):
    data = sample(spark)
    parts = U.daily_parts(enhanced(spark, data), few).cache()
    forms = {r["sparse"] for r in parts.selectExpr("bits is null as sparse").distinct().collect()}
    assert forms == ({False} if few == 0 else {True} if few == U.SPARSE_UP_TO else {True, False})
    for first, last in ((0, 4), (1, 3), (2, 2), (4, 9)):
        want = {}
        for client, _, start, gavs, dependencies in data:
            if first <= start // MILLIS_PER_DAY <= last:
                for gav in gavs:
                    want.setdefault(("indirect" if gav in dependencies else "direct", gav), set()).add(client)
        got = U.usage_of_days(parts, f"1970-01-0{1 + first}", f"1970-01-{1 + last:02d}")
        assert rows(got, "kind", "gav", "clients") == sorted((*k, len(v)) for k, v in want.items())


def test_nulls_days_before_the_epoch_and_empty(spark):
    data = [(1, 0, -5, ["a", "b"], None), (None, 0, 5, ["a"], []), (None, 1, 5, ["lost"], []), (1, 1, 5, ["a"], [])]
    df = enhanced(spark, data)
    parts = U.daily_parts(df)
    got = rows(U.usage_of_days(parts, "1969-12-31", "1970-01-01"), "gav", "clients")
    assert got == rows(R.direct_usage(df), "gav", "clients") == [("a", 1), ("b", 1), ("lost", 0)]
    assert U.usage_of_days(parts, "1971-01-01", "1971-12-31").count() == 0
    none = U.daily_parts(spark.createDataFrame([], SCHEMA))
    assert U.usage_of_days(none, "1970-01-01", "1970-01-02").count() == 0


def test_a_report_reads_only_its_days(spark, tmp_dir):
    enhanced(spark, sample(spark)).write.parquet(f"{tmp_dir}/enhanced")
    whole = ("1970-01-01T00-00Z", "1970-01-06T00-00Z")
    jobs.daily_parts(spark, f"{tmp_dir}/enhanced", f"{tmp_dir}/parts", *whole)
    before = {f for f in spark.read.parquet(f"{tmp_dir}/parts").inputFiles() if "day=1970-01-02" not in f}
    jobs.daily_parts(spark, f"{tmp_dir}/enhanced", f"{tmp_dir}/parts", "1970-01-02T00-00Z", "1970-01-03T00-00Z")
    parts = spark.read.parquet(f"{tmp_dir}/parts")
    assert before == {f for f in parts.inputFiles() if "day=1970-01-02" not in f}
    with pytest.raises(ValueError, match="whole"):
        jobs.daily_parts(spark, f"{tmp_dir}/enhanced", f"{tmp_dir}/parts", "1970-01-02T01-00Z", whole[1])
    some = U.usage_of_days(parts, "1970-01-02", "1970-01-03")
    assert "PartitionFilters: [isnotnull(day" in some._jdf.queryExecution().executedPlan().toString()
    paths = jobs.report_days(spark, f"{tmp_dir}/parts", f"{tmp_dir}/reports", "1970-01-02", "1970-01-03")
    direct, indirect = (rows(spark.read.csv(p, schema="gav string, clients long")) for p in paths)
    assert [("direct", *r) for r in direct] + [("indirect", *r) for r in indirect] == rows(some, "kind", "gav", "clients")
