from depuse.plans import cli
from depuse.sources import driver
from depuse.sources.tables import read_table
from tests.conftest import SF


def test_cli_runs_the_pipeline(spark, tmp_dir):
    driver.repository_log_lines(spark, SF).write.text(f"{tmp_dir}/logs")
    driver.dependency_record_lines(spark, SF).write.text(f"{tmp_dir}/records")
    start, end = "2024-01-01T00-00Z", "2024-02-01T00-00Z"
    steps = [
        ["build-graph", "--records", f"{tmp_dir}/records", "--out", f"{tmp_dir}/graph"],
        ["resolve", "--logs", f"{tmp_dir}/logs", "--records", f"{tmp_dir}/records", "--out", f"{tmp_dir}/gl"],
        ["sessionise", "--gav-logs", f"{tmp_dir}/gl", "--out", f"{tmp_dir}/s", "--max-idle-ms", "43200000"],
        ["dependencies", "--sessions", f"{tmp_dir}/s", "--graph", f"{tmp_dir}/graph", "--out", f"{tmp_dir}/e",
         "--start", start, "--end", end, "--depth", "0"],
        ["report", "--enhanced", f"{tmp_dir}/e", "--out", f"{tmp_dir}/r", "--start", start, "--end", end, "--daily"],
    ]
    out = [cli.main(step, spark=spark) for step in steps]
    assert out[0]["nodes"] > 0
    assert read_table(spark, f"{tmp_dir}/e").count() == read_table(spark, f"{tmp_dir}/s").count()
    assert len(out[-1]["reports"]) == 2 and len(out[-1]["daily"]) == 2
