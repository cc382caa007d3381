"""Time functions of the probes; days are calendar days, months start at their first day."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_watermark(value: datetime | date) -> datetime:
    """Naive UTC, whole seconds."""
    if value is None or value != value:
        raise ValueError("a watermark is needed")
    if not isinstance(value, datetime):
        value = datetime(value.year, value.month, value.day)
    if value.tzinfo is not None:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return value.replace(microsecond=0)


def timestamp(value: datetime) -> Column:
    return F.lit(normal_watermark(value).isoformat(sep=" ")).cast("timestamp_ntz")


def day_difference(start: Column, end: Column) -> Column:
    """Calendar days from start to end, whatever the time of day."""
    return F.datediff(end, start)


def month_floor(c: Column) -> Column:
    return F.trunc(c, "MM")


def time_bucket(c: Column, bucket: str) -> Column:
    """Start of the day or hour, as a timestamp without zone."""
    return (c.cast("date") if bucket == "day" else F.date_trunc("hour", c)).cast("timestamp_ntz")


def month_end(c: Column) -> Column:
    """First instant of the next month."""
    return F.add_months(c, 1)


def extraction_start(as_of: datetime, months: int) -> date:
    """First day of the earliest of so many months, as_of's own included."""
    at = as_of.year * 12 + as_of.month - 1 - (months - 1)
    return date(at // 12, at % 12 + 1, 1)


def next_month(d: date) -> datetime:
    return datetime(d.year + d.month // 12, d.month % 12 + 1, 1)




def elapsed_days(start: Column, end: Column) -> Column:
    """Days between timestamps without zone, with their fraction."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(86_400_000_000.0)


def complete_back_to(as_of: datetime, wait_days: int | None) -> date | None:
    return None if wait_days is None else (as_of - timedelta(days=wait_days)).date()
