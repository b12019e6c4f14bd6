"""Time arithmetic on whole microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_MINUTE = 60_000_000


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def micros_between(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end))


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return micros_between(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _col(ts).cast("timestamp_ntz"))


def hours_between(start: Column | str, end: Column | str) -> Column:
    return micros_between(start, end) / F.lit(float(MICROS_PER_HOUR))


def plus_micros(ts: Column | str, amount: Column) -> Column:
    return F.timestamp_add("MICROSECOND", amount, _col(ts))


def bucket_number(ts: Column | str, minutes: int) -> Column:
    """Number of the ``minutes`` long interval since 1970 that holds ``ts``."""
    return F.floor(micros(ts) / F.lit(minutes * MICROS_PER_MINUTE)).cast("bigint")
