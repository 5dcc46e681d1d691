"""Tables that stay where their keys belong while a loop adds to them.

A loop that looks every new row up in all rows found so far reshuffles the
latter each round, which costs rounds x rows.  Here the rows found are a table
bucketed by the key's hash: a round shuffles what is new, once, to the buckets,
and the join reads the table's buckets in place.  Each round's rows are a
``level`` of the table (a partition folder), so the last round's rows can be
read alone.

The files lie under ``spark.checkpoint.dir``, so a lost executor costs a
re-read.  The bucketing is known to the session's catalog only; ``close()``
drops that entry and reads the same files as a plain table.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depuse.session import ensure_checkpoint_dir

LEVEL = "level"
SMALL_ROWS = 1_000_000
COMPRESSION = "zstd"  # names of which most differ are plain text in Parquet; half of what snappy leaves
FOLD_LEVELS = 8  # plain levels that ``all()`` unites one by one at most


def staged(df: DataFrame) -> DataFrame:
    """The rows as Parquet files in the checkpoint folder.  They take a fraction
    of a checkpoint's bytes, readers take the columns they use, and their known
    size lets Spark broadcast a small table without shuffling the other side."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", COMPRESSION).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class PlacedTable:
    """Rows of one schema in ``buckets`` buckets by the hash of ``key``.

    ``buckets`` is the session's number of shuffle partitions if not given:
    Spark then deals the other side of a join to just these buckets.  Up to
    ``small`` rows the levels are plain checkpoints, whose reshuffling costs
    less than the bucketed files do; beyond, all of them are placed.  ``all()``
    folds plain levels into one checkpoint every ``FOLD_LEVELS`` of them.
    """

    def __init__(self, spark: SparkSession, key: Sequence[str], buckets: int | None = None, small: int | None = None):
        self.spark = spark
        self.key = list(key)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.small = SMALL_ROWS if small is None else small
        self.name = f"placed_{uuid.uuid4().hex}"
        self.path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{self.name}"
        self.schema = None
        self.levels = 0
        self.rows = 0
        self.plain: list[DataFrame] | None = [] if self.small else None  # None: placed
        self.folded: list[DataFrame] = []  # the first plain levels in one checkpoint
        self.folds = 0  # how many levels that are

    @property
    def placed(self) -> bool:
        return self.plain is None

    def append(self, rows: DataFrame, *measures: Column) -> tuple:
        """Add the rows as the next level; (row count, *measures), the latter
        being aggregates observed while writing."""
        seen = Observation()
        measured = [F.count(F.lit(1)).alias("m0"), *[m.alias(f"m{i}") for i, m in enumerate(measures, 1)]]
        watched = rows.observe(seen, *measured)
        self.schema = self.schema or rows.schema
        if self.plain is None:
            self._write(watched, self.levels)
        else:
            self.plain.append(watched.checkpoint(eager=True))
        self.levels += 1
        found = seen.get
        count = int(found["m0"] or 0)
        self.rows += count
        if self.plain is not None and self.rows > self.small:
            levels, self.plain, self.folded = self.plain, None, []
            for number, level in enumerate(levels):
                self._write(level, number)
        return (count, *[found[f"m{i}"] for i in range(1, len(measures) + 1)])

    def _write(self, rows: DataFrame, level: int) -> None:
        (
            rows.withColumn(LEVEL, F.lit(level))
            .write.format("parquet").mode("append").partitionBy(LEVEL).bucketBy(self.buckets, *self.key)
            .option("path", self.path).option("compression", COMPRESSION).saveAsTable(self.name)
        )

    def _table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def all(self) -> DataFrame:
        """Every row, read in its buckets."""
        if self.plain is not None:
            if self.levels - self.folds > FOLD_LEVELS:
                together = functools.reduce(DataFrame.unionByName, self.folded + self.plain[self.folds:])
                self.folded, self.folds = [together.coalesce(self.buckets).checkpoint(eager=True)], self.levels
            return functools.reduce(DataFrame.unionByName, self.folded + self.plain[self.folds:])
        return self._table().drop(LEVEL)

    def level(self, number: int) -> DataFrame:
        """The rows of one ``append``."""
        if self.plain is not None:
            return self.plain[number]
        return self._table().filter(F.col(LEVEL) == number).drop(LEVEL)

    def levelled(self) -> DataFrame:
        """Every row with the number of its ``append`` (column ``level``)."""
        if self.plain is not None:
            return functools.reduce(DataFrame.unionByName, (rows.withColumn(LEVEL, F.lit(n)) for n, rows in enumerate(self.plain)))
        return self._table()

    def close(self) -> DataFrame:
        """Every row, from plain files; the catalog's entry goes."""
        if self.plain is not None:
            return self.all()
        schema = T.StructType([*self.schema.fields, T.StructField(LEVEL, T.IntegerType())])
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")  # of a given path: the files stay
        return self.spark.read.schema(schema).parquet(self.path).drop(LEVEL)
