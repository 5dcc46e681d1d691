import glob

from depuse.operators import report as R
from depuse.operators import sessions as S
from tests.conftest import rows

SCHEMA = ("clientId int, sessionId bigint, startTime bigint, endTime bigint, gavs array<string>, "
          "dependencies array<string>, execMillis bigint, errorDeps string")


def enhanced(spark, data):
    return spark.createDataFrame([(c, s, t, t, g, d, -1, None) for c, s, t, g, d in data], SCHEMA)


def test_null_and_empty_dependencies(spark):
    df = enhanced(spark, [(1, 0, 10, ["a", "b"], None), (2, 0, 10, ["a", "c"], [])])
    assert rows(R.direct_usage(df)) == [("a", 2), ("b", 1), ("c", 1)]
    assert R.indirect_usage(df).count() == 0


def test_client_counted_once_and_both_reports(spark):
    df = enhanced(spark, [
        (1, 0, 10, ["a", "b"], ["b"]),
        (1, 1, 20, ["a", "b"], ["b"]),
        (2, 0, 10, ["b"], []),
    ])
    assert rows(R.direct_usage(df)) == [("a", 1), ("b", 1)]
    assert rows(R.indirect_usage(df)) == [("b", 1)]


def test_range_end_excluded(spark):
    df = enhanced(spark, [(1, 0, 10, ["a"], []), (2, 0, 20, ["a"], [])])
    assert rows(R.direct_usage(S.between(df, 10, 20))) == [("a", 1)]


def test_sizes_add_up(spark):
    df = enhanced(spark, [(1, 0, 10, ["a", "b", "c"], ["b", "c"]), (1, 1, 10, ["x"], [])])
    split = R.direct_indirect(df).collect()
    for r in split:
        assert len(r["gavs"]) == len(r["direct"]) + len(r["indirect"])
        assert not set(r["direct"]) & set(r["indirect"])
    assert rows(R.sessions_with_dependencies(df)) == [(1, 0, 3, 1, 2)]
    assert rows(R.sessions_with_dependencies(df, with_dependencies=False)) == [(1, 1, 1, 1, 0)]


def test_by_day_and_top_k(spark):
    day = 86_400_000
    df = enhanced(spark, [(1, 0, 5, ["a"], []), (2, 0, day + 5, ["a"], []), (3, 0, day + 6, ["b"], [])])
    got = rows(R.usage_by_day(df), "gav", "clients")
    assert got == [("a", 1), ("a", 1), ("b", 1)]
    assert [r["gav"] for r in R.top_k(R.direct_usage(df), 1).collect()] == ["a"]


def test_write_report(spark, tmp_dir):
    df = enhanced(spark, [(1, 0, 10, ["a", "b"], ["b"]), (2, 0, 10, ["a"], [])])
    direct, indirect = R.write_report(df, tmp_dir, "2014-06-18T00:00Z", "2014-06-19T00-00Z")
    assert direct.endswith("2014-06-18T00-00Z_2014-06-19T00-00Z_direct.csv")
    text = "".join(open(f).read() for f in sorted(glob.glob(direct + "/part-*")))
    assert text.splitlines() == ["a,2"]
    assert spark.read.csv(indirect).count() == 1


def test_write_daily_reports(spark, tmp_dir):
    day = 86_400_000
    df = enhanced(spark, [(1, 0, 5, ["a", "b"], ["b"]), (2, 0, day + 5, ["a"], []), (3, 0, day + 6, ["a"], [])])
    direct, indirect = R.write_daily_reports(df, tmp_dir)
    back = spark.read.csv(direct, schema="gav string, clients long, day date")
    assert sorted((r["day"].isoformat(), r["gav"], r["clients"]) for r in back.collect()) == [
        ("1970-01-01", "a", 1), ("1970-01-02", "a", 2)]
    assert spark.read.csv(indirect, schema="gav string, clients long, day date").count() == 1
