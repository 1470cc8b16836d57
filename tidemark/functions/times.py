"""Time buckets and time text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import fixed


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, fixed.UTC_TEXT)


def floor_minutes(ts: Column, minutes: int) -> Column:
    """Floor to ``minutes``, counted from the start of the hour.

    The count restarts every hour, so a size that does not divide 60 leaves a short last
    bucket and a size above 59 gives whole hours.
    """
    return F.date_trunc("minute", ts) - F.make_dt_interval(
        F.lit(0), F.lit(0), F.minute(ts) % F.lit(minutes))


def floor_5_minutes(ts: Column) -> Column:
    return F.window(ts, "5 minutes")["start"]


def bucket_minutes(hours: int, max_points: int) -> int:
    """Bucket size that keeps a range of ``hours`` within ``max_points``, 5 at least."""
    return max(5, hours * 60 // max_points)


TIER_FLOORS = {
    "5m": floor_5_minutes,
    "1h": lambda ts: F.date_trunc("hour", ts),
    "1d": lambda ts: F.date_trunc("day", ts),
}
