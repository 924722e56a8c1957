"""Time windows: the range grammar, bucket widths and whole-bucket bounds. Plain Python on two datetimes."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

_MINUTE, _HOUR, _DAY = 60, 3600, 86400
#: Widths that a timeline may take, in seconds.
NICE_WIDTHS = (60, 120, 300, 600, 900, 1800, _HOUR, 2 * _HOUR, 3 * _HOUR, 6 * _HOUR, 12 * _HOUR, _DAY, 2 * _DAY, 3 * _DAY, 7 * _DAY, 14 * _DAY, 30 * _DAY)
MOST_POINTS = 180
_NAMED = {
    "15m": ("15m", 15 * _MINUTE), "30m": ("30m", 30 * _MINUTE), "1h": ("1h", _HOUR), "": ("1h", _HOUR), "3h": ("3h", 3 * _HOUR), "6h": ("6h", 6 * _HOUR),
    **dict.fromkeys(("24h", "daily", "day"), ("24h", _DAY)), **dict.fromkeys(("7d", "weekly", "week"), ("7d", 7 * _DAY)),
    **dict.fromkeys(("30d", "monthly", "month"), ("30d", 30 * _DAY)), **dict.fromkeys(("90d", "quarterly", "quarter"), ("90d", 90 * _DAY)),
    **dict.fromkeys(("365d", "annual", "yearly", "year", "1y"), ("365d", 365 * _DAY)),
}
_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1, "m": _MINUTE, "h": _HOUR}


def parse_range(text: str, aliases: bool = True) -> tuple[timedelta, str]:
    """Length and label of a range; durations such as 1h30m are taken as they stand, all else is one hour."""
    text = text.strip().lower()
    if text in _NAMED and (aliases or _NAMED[text][0] == text or not text):
        label, seconds = _NAMED[text]
        return timedelta(seconds=seconds), label
    parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)", text)
    if parts and "".join(a + b for a, b in parts) == text.lstrip("+"):
        seconds = sum(float(a) * _UNITS[b] for a, b in parts)
        if seconds > 0:
            return timedelta(seconds=seconds), text
    return timedelta(hours=1), "1h"


def resolve(now: datetime, text: str = "", since: datetime | None = None, until: datetime | None = None) -> tuple[datetime, datetime, str]:
    """(since, until, label) of a request; explicit bounds make it ``custom``."""
    length, label = parse_range(text)
    if since or until:
        label = "custom"
    since, until = since or now - length, until or now
    if until <= since:
        raise ValueError("to must be after from")
    return since, until, label


def bucket_seconds(length: timedelta) -> int:
    """Width of a timeline's buckets: by span, then wide enough for 180 points at most."""
    seconds = length.total_seconds()
    width = next((w for most, w in ((3 * _HOUR, 60), (12 * _HOUR, 300), (3 * _DAY, 900), (14 * _DAY, _HOUR)) if seconds <= most), _DAY)
    if seconds > 0 and int(seconds) // width > MOST_POINTS:
        least = -(-seconds // MOST_POINTS)
        width = next((w for w in NICE_WIDTHS if w >= least), NICE_WIDTHS[-1])
    return width


def _floor(t: datetime, width: int) -> datetime:
    day = t.replace(hour=0, minute=0, second=0, microsecond=0)
    return day + timedelta(seconds=int((t - day).total_seconds()) // width * width)


def whole(since: datetime, until: datetime, width: int) -> tuple[datetime, datetime]:
    """The whole minutes (60) or hours (3600) inside a window: start rounded up, end down. Empty if start >= end."""
    start = _floor(since, width)
    return start if start == since else start + timedelta(seconds=width), _floor(until, width)


#: Least and most hours of a span, its label, and the kind of report it makes.
SPANS = (
    (360 * 24, 370 * 24, "365d", "annual"), (85 * 24, 95 * 24, "90d", "quarterly"), (29 * 24, 31 * 24, "30d", "monthly"), (6 * 24, 8 * 24, "7d", "weekly"),
    (23, 25, "24h", "daily"), (50 / 60, 70 / 60, "1h", "period"),
)


def span_of(since: datetime, until: datetime) -> tuple[str, str]:
    """Label and kind of report of a window: the usual span that it is close to, else its length to the minute."""
    hours = (until - since).total_seconds() / _HOUR
    for least, most, label, kind in SPANS:
        if least <= hours <= most:
            return label, kind
    minutes = int(hours * 60 + 0.5)
    parts = [f"{minutes // 60}h"] * (minutes >= 60) + [f"{minutes % 60}m"] * (minutes > 0)
    return "".join([*parts, "0s"]), "period"
