import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from depuse.operators.skew import salted_join
from depuse.operators.topn import free_name, top_rows
from tests.conftest import rows


@pytest.mark.parametrize("n, salts", [(1, 64), (5, 3), (400, 8)])
def test_two_steps_choose_what_one_sort_chooses(spark, n, salts):
    table = spark.range(900).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 2 == 0, F.lit("cold")).alias("g"),
        (F.col("id") * 7 % 90).alias("v"), F.col("id").alias("_rank"), F.lit(1).alias("_part"),
    )
    order = [F.desc("v"), F.asc("_rank")]
    got = top_rows(table, ["g"], order, n, ["_rank"], out="r", salts=salts)
    want = table.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(*order))).filter(F.col("r") <= n)
    assert got.columns == want.columns and rows(got) == rows(want)
    assert top_rows(table, ["g"], order, n, ["_rank"]).columns == table.columns


def test_last_task_reads_a_bounded_number_of_rows(spark):
    """Whatever reaches the last window was among its part's first n."""
    table = spark.range(0, 20_000, 1, 40).select(F.lit("one").alias("g"), "id")
    ranked = top_rows(table, ["g"], [F.asc("id")], 3, ["id"], salts=16)
    assert [r[1] for r in rows(ranked)] == [0, 1, 2]
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") >= 2 and plan.count("<= 3") >= 2


def test_free_names():
    assert free_name(["a", "B_", "b"], "B") == "B__" and free_name([], "x") == "x"


def test_salted_join_keeps_columns_of_its_own_names(spark):
    big = spark.range(60).select((F.col("id") % 2).alias("k"), F.col("id").alias("_salt"), F.lit("h").alias("_hot"))
    small = spark.createDataFrame([(0, 5)], "k long, _salt_ int")
    got = salted_join(big, small, ["k"], salts=4)
    assert rows(got) == sorted((0, i, "h", 5) for i in range(0, 60, 2))
