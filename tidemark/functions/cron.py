"""Five-field cron expressions: whether a time matches, and the next one that does."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

#: Least and greatest value of each field, and how many days ahead a match is looked for.
FIELDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
HORIZON_DAYS = 8 * 366


def parse(expression: str) -> list[set[int] | None]:
    """Values of each field; None stands for a star."""
    parts = expression.split()
    if len(parts) != 5:
        raise ValueError("a cron expression has five fields")
    out: list[set[int] | None] = []
    for text, (low, high) in zip(parts, FIELDS):
        if text == "*":
            out.append(None)
            continue
        values: set[int] = set()
        for item in text.split(","):
            span, _, step = item.partition("/")
            a, _, b = span.partition("-")
            first, last = (low, high) if span == "*" else (int(a), int(b or (high if step else a)))
            if not low <= first <= last <= high or (step and int(step) < 1):
                raise ValueError(f"{item} is out of range")
            values |= set(range(first, last + 1, int(step or 1)))
        out.append({v % 7 for v in values} if high == 7 else values)
    return out


def day_matches(fields: list[set[int] | None], at: datetime) -> bool:
    """With both day fields given, either is enough."""
    _, _, day, month, week = fields
    if month is not None and at.month not in month:
        return False
    by_day, by_week = day is None or at.day in day, week is None or (at.weekday() + 1) % 7 in week
    return by_day or by_week if day is not None and week is not None else by_day and by_week


def matches(expression: str, at: datetime) -> bool:
    f = parse(expression)
    return day_matches(f, at) and all(v is None or x in v for v, x in zip(f, (at.minute, at.hour)))


def next_fire(expression: str, after: datetime, zone: str = "UTC") -> datetime | None:
    """First local time after `after` (aware, or naive UTC) that matches and exists in the zone; None within eight years."""
    fields, tz = parse(expression), ZoneInfo(zone)
    start = (after if after.tzinfo else after.replace(tzinfo=timezone.utc)).astimezone(tz)
    day = start.replace(hour=0, minute=0, second=0, microsecond=0, tzinfo=None)
    hours, minutes = sorted(fields[1] or range(24)) if fields[1] is not None else range(24), sorted(fields[0]) if fields[0] is not None else range(60)
    for _ in range(HORIZON_DAYS):
        if day_matches(fields, day):
            for h in hours:
                for m in minutes:
                    local = day.replace(hour=h, minute=m)
                    at = local.replace(tzinfo=tz)
                    if at.astimezone(timezone.utc).astimezone(tz).replace(tzinfo=None) == local and at > start:
                        return at
        day += timedelta(days=1)
    return None


def next_expected(expression: str | None, last: datetime, zone: str = "UTC", grace_hours: float = 0.0) -> datetime | None:
    """When the run after `last` is overdue: the next match and the grace; None without a schedule."""
    at = next_fire(expression, last, zone) if expression else None
    return None if at is None else (at.astimezone(timezone.utc) + timedelta(hours=grace_hours)).astimezone(at.tzinfo)
