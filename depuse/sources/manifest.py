"""Tables that know what they were built from, reused only if that still holds.

A managed table is a folder:

    <path>/build-<id>/     the rows, one folder a build
    <path>/manifest/       one row a finished build

A build writes its rows first and its manifest row last.  That row is one file,
which the committer renames into place, so a build appears whole or not at all:
a killed one leaves a folder that nothing names.  A row holds the parameters, a
fingerprint of the input files (path, size, modification time), the columns and
the number of rows.  A table is reused when its newest build for these
parameters and inputs has a row; otherwise it is built anew beside the others,
so readers of an older build keep their files.

Defined results: a folder without a manifest is built, whatever else lies in
it; a plain table written there by other means stays and is not read.  Missing
input paths raise the error of the scan.  Files whose names start with ``_`` or
``.`` are no input.  With no inputs only the parameters count.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST = "build string, parameters string, n_files long, n_bytes long, files_hash string, n_rows long, built_at timestamp"
_IDENTITY = ["parameters", "n_files", "n_bytes", "files_hash"]


def input_fingerprint(spark: SparkSession, inputs: Sequence[str]) -> tuple[int, int, str]:
    """Number, bytes and an order-free hash of the files below ``inputs``.

    The listing is a scan of file metadata (contents are not read); one row
    reaches the driver.
    """
    if not inputs:
        return 0, 0, "0"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(inputs))
    one = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    row = files.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(one), F.lit(0)).cast("string").alias("hash"),
    ).first()
    return row["n"], row["bytes"], row["hash"]


def builds(spark: SparkSession, path: str) -> DataFrame:
    """Finished builds of a managed table, ``MANIFEST`` columns."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}/manifest")
    except AnalysisException as err:
        if "PATH_NOT_FOUND" not in str(err.getCondition() or err):
            raise
        return spark.createDataFrame([], MANIFEST)


def reuse_or_build(
    spark: SparkSession,
    path: str,
    create: Callable[[], DataFrame],
    parameters: Mapping | None = None,
    inputs: Sequence[str] = (),
    rebuild: bool = False,
) -> DataFrame:
    """The managed table at ``path`` for these parameters and input files.

    ``create`` runs only when no finished build has them, or with ``rebuild``.
    The inputs are listed before it runs, so files that arrive meanwhile make
    the next call build again.
    """
    base = path.rstrip("/")
    text = json.dumps(dict(parameters or {}), sort_keys=True, default=str)
    wanted = (text, *input_fingerprint(spark, inputs))
    if not rebuild:
        same = builds(spark, base)
        for name, value in zip(_IDENTITY, wanted):
            same = same.filter(F.col(name) == F.lit(value))
        newest = same.orderBy(F.desc("built_at"), F.desc("build")).first()
        if newest:
            return spark.read.parquet(f"{base}/build-{newest['build']}")
    build, written = uuid.uuid4().hex, Observation()
    create().observe(written, F.count(F.lit(1)).alias("n")).write.parquet(f"{base}/build-{build}")
    row = (build, *wanted, int(written.get["n"] or 0))
    done = spark.createDataFrame([row], MANIFEST.rsplit(",", 1)[0]).withColumn("built_at", F.current_timestamp())
    done.coalesce(1).write.mode("append").parquet(f"{base}/manifest")
    return spark.read.parquet(f"{base}/build-{build}")
