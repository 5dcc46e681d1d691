import datetime as dt

import pytest
from pyspark.sql import functions as F

from depuse.functions.arrays import sorted_text, top_level
from depuse.functions.sentinels import is_sentinel_only, strip_sentinels
from depuse.functions.time import bound_millis, epoch_millis, millis_to_day, parse_bound


def test_parse_bound_both_forms():
    assert parse_bound("2014-06-18T00-00Z") == 1403049600000
    assert parse_bound("2014-06-18T00:00Z") == 1403049600000
    assert parse_bound("2014-06-18T02-00+0200") == 1403049600000
    for text in ("2014-06-18T02-00+02", "2014-06-18T02:00+02", "2014-06-17T19-30-0430"):
        assert parse_bound(text) == 1403049600000
    assert parse_bound(5) == 5
    for bad in ("2014-06-18T02-00+02:00", "2014-06-18T00-00", "2014-06-18"):
        with pytest.raises(ValueError):
            parse_bound(bad)
    with pytest.raises(ValueError):
        parse_bound("18/06/2014")


def test_bound_millis_column(spark):
    same = ["2014-06-18T00-00Z", "2014-06-18T00:00Z", "2014-06-18T02-00+02", "2014-06-17T19-30-0430"]
    df = spark.createDataFrame([(t,) for t in [*same, "junk", "2014-06-18T02-00+02:00"]], "t string")
    assert [r[0] for r in df.select(bound_millis(F.col("t"))).collect()] == [1403049600000] * 4 + [None] * 2


def test_epoch_millis_ignores_session_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 7, 179575),)], "ts timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert df.select(epoch_millis(F.col("ts"))).first()[0] == 1704067207179
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_millis_to_day_is_utc(spark):
    df = spark.createDataFrame([(86_400_000 - 1,), (86_400_000,), (-1,)], "ms bigint")
    days = [r[0].isoformat() for r in df.select(millis_to_day(F.col("ms"))).collect()]
    assert days == ["1970-01-01", "1970-01-02", "1969-12-31"]


def test_sentinels_and_arrays(spark):
    df = spark.createDataFrame(
        [(["NO_DEPS"],), (["UNKNOWN_DEPS", "UNKNOWN_DEPS"],), (["NO_DEPS", "UNKNOWN_DEPS"],), (["a", "NO_DEPS"],), ([],)],
        "d array<string>")
    got = df.select(is_sentinel_only(F.col("d")), strip_sentinels(F.col("d"))).collect()
    assert [(r[0], r[1]) for r in got] == [(True, []), (True, []), (False, []), (False, ["a"]), (False, [])]
    g = spark.createDataFrame([(["b", "a", "c"], None), (["b", "a"], ["a"])], "g array<string>, d array<string>")
    assert [r[0] for r in g.select(sorted_text(top_level(F.col("g"), F.col("d")))).collect()] == ["a,b,c", "b"]
