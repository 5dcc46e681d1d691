from pyspark.sql import functions as F

from depuse.operators.skew import hot_keys, salted_join
from tests.conftest import rows


def test_salted_join_matches_plain(spark):
    big = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
        F.col("id"))
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k7", 4)], "k string, v int")
    assert [r["k"] for r in hot_keys(big, ["k"], 0.2).collect()] == ["hot"]
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(salted_join(big, small, ["k"], how, salts=8)) == rows(big.join(small, "k", how)), how


def test_cluster_conf_sizes_partitions():
    from depuse.session import cluster_conf

    conf = cluster_conf(100 * 1024**4, cores=8000)  # 100 TiB over 1000 executors x 8 cores
    assert int(conf["spark.sql.shuffle.partitions"]) == 409600
    assert int(cluster_conf(10**6, cores=8)["spark.sql.shuffle.partitions"]) == 16


def test_salted_resolution_matches(spark):
    from depuse.operators.resolve import resolve_gavs
    from depuse.sources import driver
    from tests.conftest import SF

    logs, recs = driver.repository_logs(spark, SF), driver.dependency_records(spark, SF)
    cols = ("clientId", "timestamp", "agent", "gav")
    assert rows(resolve_gavs(logs, recs, salt=True), *cols) == rows(resolve_gavs(logs, recs), *cols)


def test_hash_groups_find_the_same_hot_keys(spark):
    data = [("hot", 1)] * 50 + [("warm", 2)] * 30 + [(f"k{i}", i) for i in range(100)] + [(None, 0)] * 200
    df = spark.createDataFrame(data, "k string, v int")
    for share in (0.01, 0.1, 0.2, 0.5):
        plain = rows(hot_keys(df, ["k"], share))
        assert rows(hot_keys(df, ["k"], share, coarse=True)) == plain and (None,) not in plain
    assert rows(hot_keys(df, ["k"], 0.2)) == [("hot",)]
    assert rows(hot_keys(df, ["k", "v"], 0.1, coarse=True)) == [("hot", 1), ("warm", 2)]
