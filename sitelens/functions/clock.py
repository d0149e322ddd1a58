"""UTC time arithmetic. "Now" is always passed in as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def days_between(earlier: Column, later: Column) -> Column:
    """Whole days, rounded down (so -0.96 days is -1)."""
    gap = F.unix_micros(later) - F.unix_micros(earlier)
    return ((gap - F.pmod(gap, F.lit(DAY_MICROS))) / F.lit(DAY_MICROS)).cast("int")


def iso_z(ts: Column) -> Column:
    """ISO-8601 with Z; the fraction appears only when there is one."""
    whole = F.unix_micros(ts) % 1_000_000 == 0
    return F.when(whole, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    )


def ensure_utc(raw: Column) -> Column:
    """Timestamp from text; text without an offset is taken as UTC.

    The session time zone must be UTC (see ``sitelens.session``).
    """
    return F.try_to_timestamp(F.regexp_replace(raw, "Z$", "+00:00"))
