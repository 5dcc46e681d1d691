"""Daily usage parts: distinct clients over any range of days, sessions unread.

Distinct counts do not add up over days, sets of clients do.  A part holds the
clients of one (kind, day, gav, block of 32,768 client numbers): as a list of
places in the block up to ``SPARSE_UP_TO`` clients, as a bitmap beyond, so a
gav of three clients costs three numbers and one of all clients a bit each.
Parts of the days asked for are merged by or-ing bitmaps; places of lists count
where the merged bitmap has no bit yet.  Both are exact.

Blocks split a gav that every client uses, and lists are sets map-side, so no
task holds a whole gav.  Client ids of any sign have a block and a place.

Defined results: as ``report.direct_usage`` / ``indirect_usage`` of the sessions
that start on those days (null dependencies: all gavs direct, none indirect).
Null client ids count for nobody; a gav that only such sessions have is
reported with 0 clients.  Days without parts add nothing.  Gavs are not null.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depuse.functions.arrays import bit_is_set
from depuse.functions.time import millis_to_day
from depuse.operators.graph import materialise
from depuse.operators.report import direct_indirect

SPARSE_UP_TO = 512
DAY = "day"
KEYS = ["kind", DAY, "gav", "block"]


def daily_parts(enhanced: DataFrame, sparse_up_to: int = SPARSE_UP_TO) -> DataFrame:
    """``kind, day, gav, block, places ARRAY<INT>, bits BINARY``: one row per
    key, with its clients in one of the two."""
    split = direct_indirect(enhanced)
    client, day = F.col("clientId").cast("long"), millis_to_day(F.col("startTime")).alias(DAY)
    kinds = [
        split.select(F.lit(kind).alias("kind"), day, F.explode(kind).alias("gav"), client.alias("client"))
        for kind in ("direct", "indirect")
    ]
    used = kinds[0].unionByName(kinds[1])
    placed = used.select(
        "kind", DAY, "gav", F.bitmap_bucket_number("client").alias("block"), F.bitmap_bit_position("client").cast("int").alias("place")
    )
    # at most 32,768 places a key
    sets = materialise(placed.groupBy(*KEYS).agg(F.collect_set("place").alias("places")))
    few = sets.filter(F.size("places") <= sparse_up_to).withColumn("bits", F.lit(None).cast("binary"))
    many = sets.filter(F.size("places") > sparse_up_to).select(*KEYS, F.explode("places").alias("place"))
    bitmaps = many.groupBy(*KEYS).agg(F.bitmap_construct_agg(F.col("place").cast("long")).alias("bits"))
    return few.unionByName(bitmaps.withColumn("places", F.lit(None).cast("array<int>")))


def usage_of_days(parts: DataFrame, first_day: str | _dt.date, last_day: str | _dt.date) -> DataFrame:
    """``kind, gav, clients``: distinct clients of each gav over the days
    ``first_day`` to ``last_day``, both included (dates or ``YYYY-MM-DD``)."""
    first, last = (F.lit(str(d)).cast("date") for d in (first_day, last_day))
    chosen = parts.filter(F.col(DAY).between(first, last))
    keys = ["kind", "gav", "block"]
    bitmaps = chosen.filter("bits is not null").groupBy(*keys).agg(F.bitmap_or_agg("bits").alias("merged"))
    places = chosen.filter("bits is null").select(*keys, F.explode_outer("places").alias("place")).distinct()
    fresh = F.col("merged").isNull() | ~bit_is_set(F.col("merged"), F.col("place"))
    listed = places.join(bitmaps, keys, "left").select("kind", "gav", F.when(fresh, F.col("place")).alias("place"))
    counts = listed.groupBy("kind", "gav").agg(F.count("place").alias("n"))
    whole = bitmaps.select("kind", "gav", F.bitmap_count("merged").alias("n"))
    return counts.unionByName(whole).groupBy("kind", "gav").agg(F.sum("n").cast("bigint").alias("clients"))
