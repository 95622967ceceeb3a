"""Times: batch stamps, strict forms, ages, windows."""

from __future__ import annotations

import email.utils
import math
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rolling windows of the intelligence view, in hours.
WINDOWS = {"6h": 6, "24h": 24, "7d": 168}
_RFC3339 = r"^(\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(?:\.\d+)?)(?:[Zz]|([+-])([01]\d|2[0-3]):([0-5]\d))$"
_ISO_UTC = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{3})?Z$"


def batch_timestamp(stamp: Column) -> Column:
    """yyyyMMddHHmmss as a time; null for what is none."""
    return F.when(stamp.rlike(r"^\d{14}$"), F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")))


def seen_date(stamp: Column) -> Column:
    """yyyyMMddTHHmmss, with or without a Z, in UTC; or any form that a cast reads; null for others."""
    compact = F.regexp_extract(stamp, r"^(\d{8})T(\d{6})Z?$", 0)
    return F.coalesce(F.when(compact != "", F.try_to_timestamp(F.translate(compact, "TZ", ""), F.lit("yyyyMMddHHmmss"))), stamp.try_cast("timestamp"))


def rfc3339(text: Column) -> Column:
    """A strict RFC 3339 time; null for others, a day that the month lacks included."""
    part = lambda i: F.regexp_extract(text, _RFC3339, i)
    # Offsets of up to 23:59 are taken off here, as a cast reads those of up to 18:00 alone.
    offset = F.coalesce(part(3).try_cast("int") * 60 + part(4).try_cast("int"), F.lit(0)) * F.when(part(2) == "-", -1).otherwise(1)
    local = F.concat(F.upper(part(1)), F.lit("Z")).try_cast("timestamp")
    return F.when(text.rlike(_RFC3339), F.timestamp_micros(F.unix_micros(local) - offset.cast("long") * 60_000_000))


def is_iso_utc(text: Column) -> Column:
    return F.coalesce(text.rlike(_ISO_UTC) & text.try_cast("timestamp").isNotNull(), F.lit(False))


def age_seconds(latest: Column, now: Column) -> Column:
    """Whole seconds since latest, at least 0; null of a null."""
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    return F.when(latest.isNotNull(), F.greatest(F.lit(0).cast("long"), F.floor((micros(now) - micros(latest)) / F.lit(1_000_000)).cast("long")))


def window_start(window: str, now: datetime) -> datetime:
    """Where a rolling window begins; now is always given, never read from a clock."""
    return now - timedelta(hours=WINDOWS[window])


def request_window(now: datetime, hours: float = 24, start: datetime | None = None, end: datetime | None = None) -> tuple[datetime, datetime]:
    """The window of a request: of 0 to 168 hours, increasing."""
    if not math.isfinite(hours) or hours <= 0 or hours > 168:
        raise ValueError("hours must be in (0, 168]")
    end = end or now
    start = start or end - timedelta(hours=hours)
    if start >= end:
        raise ValueError("a window needs increasing times")
    return start, end


def retry_after(value: str | None, now: datetime) -> float | None:
    """Seconds of a Retry-After header: a number, or a date."""
    if value is None:
        return None
    try:
        seconds = float(value)
        return seconds if math.isfinite(seconds) and seconds >= 0 else None
    except ValueError:
        pass
    try:
        when = email.utils.parsedate_to_datetime(value)
    except (TypeError, ValueError):
        return None
    when = when if when.tzinfo else when.replace(tzinfo=timezone.utc)
    return float(max(0, math.ceil((when - now).total_seconds())))
