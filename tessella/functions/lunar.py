"""Seconds since the lunar epoch, 1969-07-20 20:17:40 UTC, and timestamps (TM1-TM4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The epoch in Unix seconds.
EPOCH = -14_182_940


def _micros(ts: Column) -> Column:
    """Microseconds since the epoch; timestamps without zone are taken as UTC (set spark.sql.session.timeZone to UTC)."""
    return F.unix_micros(ts.cast("timestamp")) - F.lit(EPOCH * 1_000_000)


def to_seconds(ts: Column) -> Column:
    """Whole seconds since the epoch as double, cut toward the epoch."""
    micros = _micros(ts)
    return ((micros - micros % 1_000_000) / 1_000_000).cast("double")


def to_micros(ts: Column) -> Column:
    """Microseconds since the epoch as bigint."""
    return _micros(ts)


def to_timestamp(seconds: Column) -> Column:
    """The timestamp of seconds since the epoch, to the microsecond; before the epoch as well."""
    return F.timestamp_micros((seconds.cast("decimal(20,6)") * 1_000_000).cast("bigint") + F.lit(EPOCH * 1_000_000))


def display(ts: Column) -> Column:
    """YYYY-MON-DD h:mm:ss.mmm AM, in UTC."""
    return F.upper(F.date_format(ts.cast("timestamp"), "yyyy-MMM-dd h:mm:ss.SSS a"))
