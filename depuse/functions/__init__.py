"""Column expressions (built-in Spark functions only, no UDFs)."""

from depuse.functions.arrays import sorted_text, top_level
from depuse.functions.parsing import (
    LOG_LINE_PATTERN,
    RECORD_LINE_PATTERN,
    is_well_formed,
    log_fields,
    record_fields,
    split_dependencies,
)
from depuse.functions.sentinels import SENTINELS, is_sentinel_only, strip_sentinels
from depuse.functions.time import (
    BOUND_FORMATS,
    bound_millis,
    epoch_millis,
    millis_to_day,
    parse_bound,
)

__all__ = [
    "LOG_LINE_PATTERN",
    "RECORD_LINE_PATTERN",
    "SENTINELS",
    "BOUND_FORMATS",
    "bound_millis",
    "epoch_millis",
    "is_sentinel_only",
    "is_well_formed",
    "log_fields",
    "millis_to_day",
    "parse_bound",
    "record_fields",
    "sorted_text",
    "split_dependencies",
    "strip_sentinels",
    "top_level",
]
