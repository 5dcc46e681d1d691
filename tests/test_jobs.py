import glob

import pytest

from depuse.plans import jobs
from depuse.sources import driver
from depuse.sources.manifest import builds
from depuse.sources.tables import read_table
from tests.conftest import SF


def write_lines(df, path):
    df.coalesce(1).write.text(path)


def test_pipeline_end_to_end(spark, tmp_dir):
    logs_txt, recs_txt = f"{tmp_dir}/logs", f"{tmp_dir}/records"
    write_lines(driver.repository_log_lines(spark, SF), logs_txt)
    write_lines(driver.dependency_record_lines(spark, SF), recs_txt)

    counts = jobs.build_graph(spark, recs_txt, f"{tmp_dir}/graph", transitive=False)
    assert counts["nodes"] > 0 and counts["edges"] > 0 and counts["rejected"] == 3 and counts["closure"] == 0
    both = jobs.build_graph(spark, recs_txt, f"{tmp_dir}/tgraph")
    assert both["edges"] == counts["edges"] < both["closure"]

    assert jobs.resolve(spark, logs_txt, recs_txt, f"{tmp_dir}/gav_logs")["rejected"] == 11
    jobs.sessionise(spark, f"{tmp_dir}/gav_logs", f"{tmp_dir}/sessions", max_idle_ms=43_200_000)
    sessions = read_table(spark, f"{tmp_dir}/sessions")
    assert sessions.count() > 0

    start, end = "2024-01-01T00-00Z", "2024-02-01T00-00Z"
    with pytest.raises(ValueError, match="closure"):
        jobs.compute_dependencies(spark, f"{tmp_dir}/sessions", f"{tmp_dir}/graph", f"{tmp_dir}/none", start, end)
    jobs.compute_dependencies(spark, f"{tmp_dir}/sessions", f"{tmp_dir}/graph", f"{tmp_dir}/enh40", start, end, depth=40)
    jobs.compute_dependencies(spark, f"{tmp_dir}/sessions", f"{tmp_dir}/tgraph", f"{tmp_dir}/enh1", start, end)
    near = []
    for kind in ("graph", "tgraph"):  # hops are direct edges, whether or not the closure is there
        jobs.compute_dependencies(spark, f"{tmp_dir}/sessions", f"{tmp_dir}/{kind}", f"{tmp_dir}/near-{kind}", start, end, depth=2)
        near.append(sorted(map(tuple, read_table(spark, f"{tmp_dir}/near-{kind}").select("clientId", "sessionId", "dependencies").collect())))
    assert near[0] == near[1]
    e40 = read_table(spark, f"{tmp_dir}/enh40").select("clientId", "sessionId", "dependencies").collect()
    e1 = read_table(spark, f"{tmp_dir}/enh1").select("clientId", "sessionId", "dependencies").collect()
    assert sorted(map(tuple, e40)) == sorted(map(tuple, e1))

    direct, indirect = jobs.report(spark, f"{tmp_dir}/enh40", f"{tmp_dir}/reports", start, end)
    assert glob.glob(direct + "/part-*") and glob.glob(indirect + "/part-*")
    top = spark.read.csv(direct, schema="gav string, clients long").orderBy("clients", ascending=False).first()
    assert top["clients"] > 0

    d_direct, _ = jobs.daily_report(spark, f"{tmp_dir}/enh40", f"{tmp_dir}/reports", start, end)
    daily = spark.read.csv(d_direct, schema="gav string, clients long, day date")
    assert daily.select("day").distinct().count() > 1

    sweeps = [jobs.depth_sweep(spark, f"{tmp_dir}/sessions", f"{tmp_dir}/{g}", f"{tmp_dir}/sweep-{g}", depths=(2,)) for g in ("graph", "tgraph")]
    assert sorted(map(tuple, sweeps[0].collect())) == sorted(map(tuple, sweeps[1].collect()))
    res = jobs.depth_sweep(spark, f"{tmp_dir}/sessions", f"{tmp_dir}/graph", f"{tmp_dir}/prof", depths=(1, 2))
    assert res.count() > 0
    again = jobs.depth_sweep(spark, f"{tmp_dir}/sessions", f"{tmp_dir}/graph", f"{tmp_dir}/prof2", depths=(1,))
    assert again.count() * 2 == res.count()


def test_depth_sweep_reuses_what_still_holds(spark, tmp_dir):
    from depuse.plans.catalog import order_sessions

    records = f"{tmp_dir}/records"
    write_lines(driver.dependency_record_lines(spark, SF), records)
    jobs.build_graph(spark, records, f"{tmp_dir}/graph", transitive=False)
    order_sessions(spark, SF).write.parquet(f"{tmp_dir}/sessions")

    def sweep(**how):
        jobs.depth_sweep(spark, f"{tmp_dir}/sessions", f"{tmp_dir}/graph", f"{tmp_dir}/p", grid=(2, 40, 1, 3), **how)
        return [builds(spark, f"{tmp_dir}/p-{name}").count() for name in ("sample-2-40-1-3", "histogram")]

    assert sweep() == [1, 1]
    assert sweep() == [1, 1]
    assert sweep(reuse_sample=False) == [2, 2]
    read_table(spark, f"{tmp_dir}/sessions").limit(5).write.mode("append").parquet(f"{tmp_dir}/sessions")
    assert sweep() == [3, 3]
