"""Epoch-millisecond helpers.  All times inside the pipeline are longs."""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Report-bound formats.  The first is the one output names use;
# the second (colon between hour and minute) is accepted on input too.  The
# offset is Z, +HH or +HHMM, for columns and arguments alike.
BOUND_FORMATS = ("yyyy-MM-dd'T'HH-mmX", "yyyy-MM-dd'T'HH:mmX")
_BOUND = re.compile(r"(\d{4}-\d{2}-\d{2}T\d{2})[-:](\d{2})(Z|[+-]\d{2}(?:\d{2})?)")

MILLIS_PER_DAY = 86_400_000


def bound_millis(text: Column) -> Column:
    """Zoned date-time text -> epoch ms (null when no format matches)."""
    parsed = [F.try_to_timestamp(text, F.lit(fmt)) for fmt in BOUND_FORMATS]
    return F.unix_millis(F.coalesce(*parsed))


def parse_bound(text: str | int) -> int:
    """Driver-side parse of a report-bound argument (text or epoch ms)."""
    if isinstance(text, int):
        return text
    found = _BOUND.fullmatch(text.strip())
    if not found:
        raise ValueError(f"not a report bound: {text!r} (expected e.g. 2014-06-18T00-00Z)")
    hour, minute, zone = found.groups()
    offset = "+0000" if zone == "Z" else zone.ljust(5, "0")
    return int(_dt.datetime.strptime(f"{hour}-{minute}{offset}", "%Y-%m-%dT%H-%M%z").timestamp()) * 1000


def bound_name(text: str) -> str:
    """A bound as output names spell it: no colon, which some stores refuse."""
    return text.strip().replace(":", "-")


def epoch_millis(ts: Column, wall_clock: bool = True) -> Column:
    """Timestamp -> epoch ms, floored.

    ``wall_clock=True`` (TIMESTAMP_NTZ columns, read as UTC) measures the
    distance from the epoch so the session time zone plays no part;
    ``False`` is for TIMESTAMP (instant) columns.
    """
    if wall_clock:
        epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
        micros = F.timestamp_diff("MICROSECOND", epoch, ts.cast("timestamp_ntz"))
    else:
        micros = F.unix_micros(ts)
    whole = micros - F.pmod(micros, F.lit(1000))  # floor to a multiple of 1000
    return (whole / F.lit(1000)).cast("bigint")  # exact: the quotient is integral


def millis_to_day(ms: Column) -> Column:
    """Epoch ms -> UTC calendar date, independent of the session time zone."""
    days = F.floor(ms / F.lit(MILLIS_PER_DAY)).cast("int")
    return F.date_from_unix_date(days)
