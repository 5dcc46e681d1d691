import os

import pytest

from depuse.sources import manifest as M
from tests.conftest import rows


def numbers(spark, n):
    return lambda: spark.range(n)


def never():
    raise AssertionError("built again")


def test_reused_while_parameters_and_inputs_hold(spark, tmp_dir):
    path, inputs = f"{tmp_dir}/table", f"{tmp_dir}/in"
    spark.range(3).write.parquet(f"{inputs}/day=1")
    assert M.reuse_or_build(spark, path, numbers(spark, 5), {"k": 1, "grid": (1, 2)}, [inputs]).count() == 5
    assert M.reuse_or_build(spark, path, never, {"grid": (1, 2), "k": 1}, [inputs]).count() == 5
    assert M.reuse_or_build(spark, path, numbers(spark, 6), {"k": 2, "grid": (1, 2)}, [inputs]).count() == 6
    spark.range(2).write.parquet(f"{inputs}/day=2")  # a folder below the input
    assert M.reuse_or_build(spark, path, numbers(spark, 7), {"k": 2, "grid": (1, 2)}, [inputs]).count() == 7
    # what was built before still stands for its own inputs
    assert M.reuse_or_build(spark, path, never, {"k": 2, "grid": (1, 2)}, [inputs]).count() == 7
    assert rows(M.builds(spark, path), "n_rows") == [(5,), (6,), (7,)]


def test_a_changed_file_is_another_input(spark, tmp_dir):
    path, name = f"{tmp_dir}/table", f"{tmp_dir}/in.txt"
    open(name, "w").write("abc")
    first = M.input_fingerprint(spark, [name])
    assert first[:2] == (1, 3) and M.input_fingerprint(spark, [name]) == first
    M.reuse_or_build(spark, path, numbers(spark, 1), inputs=[name])
    os.utime(name, (1, 1))  # same bytes, another time
    assert M.input_fingerprint(spark, [name]) != first
    assert M.reuse_or_build(spark, path, numbers(spark, 2), inputs=[name]).count() == 2


def test_a_killed_build_is_never_reused(spark, tmp_dir):
    path = f"{tmp_dir}/table"
    broken = spark.range(100).selectExpr("if(id = 99, raise_error('lost'), id) as id")
    with pytest.raises(Exception, match="lost"):
        M.reuse_or_build(spark, path, lambda: broken, {"k": 1})
    assert M.builds(spark, path).count() == 0
    spark.range(4).write.mode("overwrite").parquet(f"{path}/build-half")  # rows without a manifest row
    assert M.reuse_or_build(spark, path, numbers(spark, 3), {"k": 1}).count() == 3
    assert M.reuse_or_build(spark, path, never, {"k": 1}).count() == 3


def test_rebuild_and_empty_tables(spark, tmp_dir):
    path = f"{tmp_dir}/table"
    assert M.reuse_or_build(spark, path, numbers(spark, 0)).count() == 0
    assert M.reuse_or_build(spark, path, never).columns == ["id"]
    assert M.reuse_or_build(spark, path, numbers(spark, 2), rebuild=True).count() == 2
    assert M.reuse_or_build(spark, path, never).count() == 2  # the newest
    assert M.input_fingerprint(spark, []) == (0, 0, "0")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        M.reuse_or_build(spark, path, never, inputs=[f"{tmp_dir}/missing"])
