"""Time parsing and freshness; `as_of` is always passed in, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([+-]\d{2}:\d{2}|Z)?)?$"


def parse_iso(value: Column) -> Column:
    """ISO date or date-time, `Z` or offset allowed, no zone means UTC, else null."""
    return F.when(value.rlike(_ISO), F.try_to_timestamp(value))


def parse_epoch_ms(value: Column) -> Column:
    """Milliseconds since the epoch."""
    return F.timestamp_millis(value.try_cast("long"))


def parse_epoch_auto(value: Column) -> Column:
    """Seconds since the epoch; values above 1e10 are read as milliseconds."""
    n = value.try_cast("long")
    secs = F.when(n > 10_000_000_000, F.floor(n / 1000)).otherwise(n)
    return F.timestamp_seconds(secs)


def posted_at(source_posted_at: Column, first_seen_at: Column) -> Column:
    """The source's date, else when it was first seen."""
    return F.coalesce(source_posted_at, first_seen_at)


def _hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3_600_000_000.0)


def freshness_tier(source_posted_at: Column, first_seen_at: Column, as_of: Column) -> Column:
    """Hot below 2 hours, warm below 24, else cool, by the smaller age."""
    posted = posted_at(source_posted_at, first_seen_at)
    age = F.least(_hours_between(as_of, first_seen_at), _hours_between(as_of, posted))
    return F.when(age < 2, "hot").when(age < 24, "warm").otherwise("cool")


def within_window(posted: Column, window: str, as_of: Column, last_visit: Column | None = None) -> Column:
    """24h, 7d, 30d or new_since_visit; rows without a date pass."""
    # fixed values: window lengths in hours
    hours = {"24h": 24, "7d": 7 * 24, "30d": 30 * 24}
    if window == "new_since_visit":
        if last_visit is None:
            return F.lit(True)
        return posted.isNull() | last_visit.isNull() | (posted > last_visit)
    if window not in hours:
        return F.lit(True)
    return posted.isNull() | (_hours_between(as_of, posted) <= hours[window])


def is_new(source_posted_at: Column, first_seen_at: Column, as_of: Column,
           last_visit: Column | None = None) -> Column:
    """Seen or posted less than a day ago, or posted after the last visit."""
    posted = posted_at(source_posted_at, first_seen_at)
    recent = (F.coalesce(_hours_between(as_of, first_seen_at) < 24, F.lit(False))
              | F.coalesce(_hours_between(as_of, posted) < 24, F.lit(False)))
    if last_visit is None:
        return recent
    return recent | F.coalesce(posted > last_visit, F.lit(False))
