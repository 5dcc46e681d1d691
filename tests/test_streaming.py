import os

from depuse.sources import driver
from depuse.streaming import resolve_stream
from tests.conftest import SF


def test_progress_is_kept_beside_the_output(spark, tmp_dir):
    """A second run without a location reads only what is new."""
    records = driver.dependency_records(spark, SF)
    driver.repository_log_lines(spark, SF).write.text(f"{tmp_dir}/in/a")
    resolve_stream(spark, f"{tmp_dir}/in/*", records, f"{tmp_dir}/out").awaitTermination()
    assert os.path.isdir(f"{tmp_dir}/out-progress")
    first = spark.read.parquet(f"{tmp_dir}/out").count()
    resolve_stream(spark, f"{tmp_dir}/in/*", records, f"{tmp_dir}/out").awaitTermination()
    assert spark.read.parquet(f"{tmp_dir}/out").count() == first


def test_incremental_resolution_matches_batch(spark, tmp_dir):
    lines = driver.repository_log_lines(spark, SF)
    first, second = lines.randomSplit([0.5, 0.5], seed=7)
    records = driver.dependency_records(spark, SF)
    first.write.text(f"{tmp_dir}/in/a")
    q = resolve_stream(spark, f"{tmp_dir}/in/*", records, f"{tmp_dir}/out", f"{tmp_dir}/ckpt")
    q.awaitTermination()
    n1 = spark.read.parquet(f"{tmp_dir}/out").count()
    second.write.text(f"{tmp_dir}/in/b")
    q = resolve_stream(spark, f"{tmp_dir}/in/*", records, f"{tmp_dir}/out", f"{tmp_dir}/ckpt")
    q.awaitTermination()
    out = spark.read.parquet(f"{tmp_dir}/out")
    from depuse.operators.resolve import resolve_gavs
    from depuse.sources.text import parse_repository_logs

    batch = resolve_gavs(parse_repository_logs(lines), records)
    assert 0 < n1 < out.count() == batch.count()
    cols = ["clientId", "timestamp", "agent", "gav"]
    assert sorted(map(tuple, out.select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))
