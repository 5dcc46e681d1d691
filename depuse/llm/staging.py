"""Stage tables: results that several later jobs read, written once.

They go to the shared folder the cluster names in ``spark.checkpoint.dir``
(a private folder only where that is unset, as in tests), so a lost executor
costs a re-read, never a recomputation, and they are columnar: a later job
reads just the columns it needs.  A checkpoint() would compute its input twice
and keep whole rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from depuse.session import ensure_checkpoint_dir


BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> None:
    """Texts are long: hand them to Python ``BATCH_ROWS`` rows at a time, not
    10,000, for the rest of the session.  Called by operators that read texts
    in Python."""
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (lineage ends here)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
