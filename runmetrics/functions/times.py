"""Clock arithmetic: durations, periods, time formats and backoff delays."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, functions as F

from .status import col

# Duration units in milliseconds (a month is 30.44 days, a year 365.25).
DURATION_UNITS_MS = {
    "ns": 1e-6, "nsec": 1e-6, "us": 1e-3, "usec": 1e-3, "ms": 1.0, "msec": 1.0,
    "s": 1e3, "sec": 1e3, "second": 1e3, "seconds": 1e3,
    "m": 6e4, "min": 6e4, "minute": 6e4, "minutes": 6e4,
    "h": 3.6e6, "hr": 3.6e6, "hour": 3.6e6, "hours": 3.6e6,
    "d": 8.64e7, "day": 8.64e7, "days": 8.64e7,
    "w": 6.048e8, "week": 6.048e8, "weeks": 6.048e8,
    "M": 2.630016e9, "month": 2.630016e9, "months": 2.630016e9,
    "y": 3.15576e10, "year": 3.15576e10, "years": 3.15576e10,
}

# Strftime codes and their date_format patterns.
STRFTIME_PATTERNS = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD",
    "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a", "I": "hh", "f": "SSSSSS",
    "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "z": "xx",
}

PERIOD_UNITS = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month"}
CLOCK_FORMAT = "%Y-%m-%d %H:%M:%S"


def java_pattern(strftime: str) -> str:
    """Translate a strftime format to a Spark date pattern."""
    pieces: list[tuple[bool, str]] = []
    for literal, code in re.findall(r"([^%]+)|%(.)", strftime, re.S):
        if literal or code in ("%", "Z"):
            text = literal or {"%": "%", "Z": "UTC"}[code]
            if pieces and pieces[-1][0]:
                text = pieces.pop()[1] + text
            pieces.append((True, text))
        elif code in STRFTIME_PATTERNS:
            pieces.append((False, STRFTIME_PATTERNS[code]))
        else:
            raise ValueError(f"unsupported time format code %{code}")
    return "".join("'" + text.replace("'", "''") + "'" if fixed else text for fixed, text in pieces)


def duration_between(start: Column | str, end: Column | str) -> Column:
    """Milliseconds from start to end, never negative; null while not ended."""
    gap = F.unix_millis(col(end)) - F.unix_millis(col(start))
    return F.when(gap.isNotNull(), F.greatest(F.lit(0).cast("long"), gap))


def whole_seconds(duration_ms: Column | str) -> Column:
    return F.floor(col(duration_ms) / 1000)


def fixed_text(value: Column | str, digits: int) -> Column:
    """A number with a fixed count of decimals, rounded from its exact value, half to even."""
    return F.call_function("format_number", col(value), F.lit("0." + "0" * digits))


def seconds_text(duration_ms: Column | str, digits: int = 1) -> Column:
    return fixed_text(col(duration_ms) / F.lit(1000.0), digits)


def clock_text(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd HH:mm:ss 'UTC'")


def rfc3339(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")


def parse_time(text: Column | str) -> Column:
    """Epoch seconds or RFC 3339 text to a timestamp; anything else is null.

    Digits are tested first: a plain number would otherwise be taken as a year.
    """
    t = col(text)
    return F.when(
        t.rlike(r"^[+-]?\d+$"), F.timestamp_seconds(t.try_cast("bigint"))
    ).when(
        t.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"),
        F.try_to_timestamp(F.upper(t)),
    )


def format_time(text: Column | str, fmt: str = CLOCK_FORMAT) -> Column:
    return F.date_format(parse_time(text), java_pattern(fmt))


def now_text(fmt: str = CLOCK_FORMAT, as_of: Column | None = None) -> Column:
    return F.date_format(F.current_timestamp() if as_of is None else as_of, java_pattern(fmt))


def duration_text_ms(text: Column | str) -> Column:
    """``1h 30m`` to 5400000; null when any part of the text is not understood."""
    t = F.trim(col(text))
    numbers = F.regexp_extract_all(t, F.lit(r"(\d+)\s*([A-Za-z]+)"), F.lit(1))
    units = F.regexp_extract_all(t, F.lit(r"(\d+)\s*([A-Za-z]+)"), F.lit(2))
    table = F.create_map(*[F.lit(x) for pair in DURATION_UNITS_MS.items() for x in pair])
    parts = F.zip_with(numbers, units, lambda n, u: n.cast("double") * F.try_element_at(table, u))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(t.rlike(r"^(\d+\s*[A-Za-z]+\s*)+$"), F.floor(total))


def backoff_delay(attempt: Column, initial_ms: Column, multiplier: Column, cap_ms: Column | int) -> Column:
    """Wait before retry number ``attempt`` (from 0): grows by the multiplier up to the cap."""
    raw = initial_ms.cast("double") * F.pow(multiplier, attempt)
    cap = F.lit(cap_ms) if isinstance(cap_ms, int) else cap_ms
    return F.floor(F.least(raw, cap.cast("double")))


def period_start(ts: Column | str, period: str) -> Column:
    """Start of the hour, day, week (Monday) or month a time falls in."""
    return F.date_trunc(PERIOD_UNITS.get(period, period), col(ts))


def next_period(start: Column, period: str) -> Column:
    unit = PERIOD_UNITS.get(period, period)
    if unit == "month":
        return F.add_months(start, 1).cast("timestamp")
    return start + F.expr(f"interval 1 {unit}")


def period_bounds(period: str, as_of: Column | None = None, approx_month: bool = False) -> tuple[Column, Column]:
    """[start, end) of the last complete period before ``as_of`` (default: now)."""
    if period not in PERIOD_UNITS:
        raise ValueError(f"unknown period {period!r}, expected one of {sorted(PERIOD_UNITS)}")
    now = F.current_timestamp() if as_of is None else as_of
    end = period_start(now, period)
    if period == "monthly":
        start = end - F.expr("interval 30 day") if approx_month else F.add_months(end, -1).cast("timestamp")
    else:
        start = end - F.expr(f"interval 1 {PERIOD_UNITS[period]}")
    return start, end


def utc(text: str) -> Column:
    """A fixed point in time given as text, for ``as_of`` arguments."""
    moment = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=dt.timezone.utc)
    return F.timestamp_micros(F.lit(int(moment.timestamp() * 1_000_000)))
