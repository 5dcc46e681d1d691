import duckdb
import pytest

import __spark_entry__ as E
from depuse.plans import catalog
from tests.conftest import SF, null_safe, rows

FAST = ["sessions", "session_flags", "graph_nodes", "rejected_lines", "report_bounds", "duplicate_paths"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["gav", "clients"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", FAST)
def test_oracle_agrees(spark, name):
    con = duckdb.connect()
    for t in ("events", "part", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = E.queries()[name](spark, SF)
    exp = con.execute(E.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(exp.columns)
    clean = exp[cols].astype(object).where(exp[cols].notna(), None)
    want = sorted((tuple(v.item() if hasattr(v, "item") else v for v in r)
                   for r in clean.itertuples(index=False, name=None)), key=null_safe)
    assert rows(got, *cols) == want


def test_only_top_k_reports_limit_rows(spark):
    limited = set()
    for name, fn in catalog.QUERIES.items():
        if name.startswith(("file_", "job_")):
            continue  # their plans begin at the table that was written
        plan = fn(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        if "GlobalLimit" in plan or "LocalLimit" in plan or "Sample" in plan:
            limited.add(name)
    assert limited == {"top10_direct", "top10_indirect"}
