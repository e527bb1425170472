"""Time column functions. The time of a run is an argument everywhere, never read from the clock inside a plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_published(text: Column, now: Column) -> Column:
    """A feed's date (RFC 822 with zone name or offset, or ISO 8601); the run's time where there is none or it can't be read."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},?\s+(?=\d)", "")
    return F.coalesce(
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss xx")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm z")),
        F.expr("null").cast("timestamp") if text is None else bare.try_cast("timestamp"), now,
    )


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def age_hours(ts: Column, now: Column) -> Column:
    """Hours from ts to now, not below 0."""
    return F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(3_600_000_000.0))


def display(ts: Column) -> Column:
    """Medium date and short time, as shown to readers."""
    return F.date_format(ts, "MMM d, yyyy, h:mm a")


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")
