"""Time functions: CF offsets, flexible parsing, fixed text formats.

All timestamps are ``timestamp_ntz`` in UTC with microsecond resolution.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_UNITS = "seconds since 1900-01-01 00:00:00"
DEFAULT_CALENDAR = "gregorian"

# Calendars with the same day count as Spark's, and CF unit names.
CALENDARS = ("gregorian", "standard", "proleptic_gregorian")
UNIT_MICROS = {
    "day": 86_400_000_000,
    "hour": 3_600_000_000,
    "minute": 60_000_000,
    "second": 1_000_000,
    "millisecond": 1_000,
    "microsecond": 1,
}
UNIT_ALIASES = {
    "d": "day",
    "h": "hour",
    "hr": "hour",
    "min": "minute",
    "s": "second",
    "sec": "second",
    "ms": "millisecond",
    "msec": "millisecond",
    "us": "microsecond",
}

# English month names, by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# The forms of a date that are read, each with the places of year, month and day among its groups.
_DATE_FORMS = (
    (r"(\d{4})(\d{2})(\d{2})", (1, 2, 3)),
    (r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})", (1, 2, 3)),
    (r"(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})", (3, 1, 2)),
    (r"(\d{1,2})[ -]([A-Za-z]{3,9})\.?[ -](\d{4}|\d{2})", (3, 2, 1)),
    (r"([A-Za-z]{3,9})\.? (\d{1,2}),? (\d{4})", (3, 1, 2)),
)
# Behind the date: nothing, or hours and minutes with colons or without, with or without a half of the day.
_CLOCK = (
    r"(?:[T ](?:(\d{1,2}):(\d{2})(?::(\d{2})(\.\d+)?)?|(\d{2})(\d{2})(\d{2}))(?: ?([AaPp])[Mm])?)?"
)
_CLOCK_GROUPS = 8
# Two-digit years from this one on lie in the last century.
_CENTURY_SPLIT = 69

_EPOCH = datetime(1970, 1, 1)
_ZONED = r"^\d{4}-\d{1,2}-\d{1,2}[T ].*(Z|UTC|[+-]\d{1,2}:?\d{2})$"


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def to_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zoneless timestamp.

    Goes through an interval, as the difference functions would read the wall
    time in the session time zone.
    """
    elapsed = (ts.cast("timestamp_ntz") - _epoch()).cast("interval second").cast("decimal(18,6)")
    return (elapsed * F.lit(1_000_000)).cast("bigint")


def from_micros(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, _epoch())


def bound_micros(value: str | datetime) -> int:
    """A request bound (text or datetime) as microseconds since 1970, on the driver."""
    return (parse_bound(value) - _EPOCH) // timedelta(microseconds=1)


def bound_column(value: str | datetime) -> Column:
    """A request bound as a literal, so that filters on it reach the scan."""
    return F.lit(parse_bound(value).isoformat(sep=" ")).cast("timestamp_ntz")


def parse_bound(value: str | datetime) -> datetime:
    if isinstance(value, str):
        value = _parse_text(value.strip())
    if value.tzinfo is not None:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return value


def _parse_text(text: str) -> datetime:
    try:
        return datetime.fromisoformat(text)
    except ValueError:
        pass
    for form, places in _DATE_FORMS:
        found = re.fullmatch(form + _CLOCK, text)
        if not found:
            continue
        year, month, day = (found.group(i) for i in places)
        if len(year) == 2:
            year = f"{19 if int(year) >= _CENTURY_SPLIT else 20}{year}"
        if not month.isdigit():
            month = MONTHS.index(month[:3].lower()) + 1 if month[:3].lower() in MONTHS else 0
        h, m, s, fraction, h2, m2, s2, half = (found.group(found.re.groups - _CLOCK_GROUPS + i) for i in range(1, 9))
        hour = int(h or h2 or 0)
        if half:
            hour = hour % 12 + (12 if half in "pP" else 0) if 1 <= hour <= 12 else 99
        micros = int(((fraction or ".0")[1:] + "000000")[:6])
        try:
            return datetime(int(year), int(month), int(day), hour, int(m or m2 or 0), int(s or s2 or 0), micros)
        except ValueError:
            continue
    raise ValueError(f"not a date and time: {text!r}")


def _iso_text(part: Column) -> Column:
    """The parts of a date and a clock, empty where they are missing, as ``yyyy-m-d h:m:s``."""
    year, month, day, h, m, s, fraction, h2, m2, s2, half = (part[i] for i in range(11))
    century = F.when(year.try_cast("int") >= _CENTURY_SPLIT, F.lit("19")).otherwise(F.lit("20"))
    year = F.when(F.length(year) == 2, F.concat(century, year)).otherwise(year)
    named = F.array_position(F.lit(list(MONTHS)), F.lower(F.substring(month, 1, 3))).cast("string")
    month = F.when(month.rlike(r"^\d"), month).otherwise(named)
    hour = F.concat(h, h2).try_cast("int")
    turned = F.pmod(hour, F.lit(12)) + F.when(F.lower(half) == "p", F.lit(12)).otherwise(F.lit(0))
    hour = F.when(half == "", F.coalesce(hour, F.lit(0))).when(hour.between(1, 12), turned).otherwise(F.lit(99))
    minute, second = F.concat(F.lit("0"), m, m2), F.concat(F.lit("0"), s, s2)
    clock = F.concat_ws(":", hour.cast("string"), F.right(minute, F.lit(2)), F.right(second, F.lit(2)))
    return F.concat(F.concat_ws("-", year, month, day), F.lit(" "), clock, fraction)


def parse_datetime(text: Column) -> Column:
    """Text to timestamp; anything that cannot be read becomes null.

    Text with a zone is moved to UTC, text without one is taken as UTC, whatever
    the zone of the session: other forms are rewritten as ISO text and read as
    zoneless. The shape decides which form is tried.
    """
    clean = F.trim(text)
    parsed = F.when(clean.rlike(_ZONED), from_micros(F.unix_micros(clean.try_cast("timestamp"))))
    parsed = parsed.when(clean.rlike(r"^\d{4}-") & ~clean.rlike("[AaPp][Mm]$"), clean.try_cast("timestamp_ntz"))
    # Every form gives the same eleven parts; they are put together once, in a lambda.
    parts = []
    for form, places in _DATE_FORMS:
        shape = "^" + form + _CLOCK + "$"
        order = "|".join(f"${i}" for i in (*places, *range(4, 4 + _CLOCK_GROUPS)))
        parts.append(F.when(clean.rlike(shape), F.regexp_replace(clean, shape, order)))
    split = F.split(F.coalesce(*parts), r"\|")
    iso = F.get(F.transform(F.array(split), _iso_text), 0)
    return parsed.otherwise(iso.try_cast("timestamp_ntz"))


def unreadable_times(df, names, tags=()):
    """``column, text, n``: the texts that ``parse_datetime`` cannot read, with their rows."""
    found = [
        F.when(
            F.col(n).isNotNull() & (F.trim(n) != "") & parse_datetime(F.col(n)).isNull(),
            F.struct(F.lit(n).alias("column"), F.col(n).alias("text")),
        )
        for n in names
    ]
    values = df.select(*tags, F.explode(F.array_compact(F.array(*found))).alias("v")).select(*tags, "v.*")
    return values.groupBy(*tags, "column", "text").agg(F.count(F.lit(1)).alias("n"))


def parse_units(units: str, calendar: str = DEFAULT_CALENDAR) -> tuple[int, datetime]:
    """``"seconds since 1900-01-01"`` to (microseconds per unit, reference time)."""
    if calendar.lower() not in CALENDARS:
        raise ValueError(f"calendar {calendar!r} is not supported; use one of {', '.join(CALENDARS)}")
    match = re.fullmatch(r"\s*(\w+)\s+since\s+(.+?)\s*", units)
    if not match:
        raise ValueError(f"time units {units!r} are not '<unit> since <reference time>'")
    word = match.group(1).lower()
    singular = word[:-1] if word.endswith("s") and len(word) > 2 and word not in UNIT_ALIASES else word
    name = UNIT_ALIASES.get(singular, singular)
    if name not in UNIT_MICROS:
        raise ValueError(f"unknown time unit {match.group(1)!r} in {units!r}")
    return UNIT_MICROS[name], parse_bound(match.group(2))


def decode_time(value: Column, units: str = DEFAULT_UNITS, calendar: str = DEFAULT_CALENDAR) -> Column:
    """CF offsets to timestamps, rounded to the microsecond."""
    factor, reference = parse_units(units, calendar)
    micros = F.round(value * F.lit(factor)).cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, bound_column(reference))


def encode_time(ts: Column, units: str = DEFAULT_UNITS, calendar: str = DEFAULT_CALENDAR) -> Column:
    """Timestamps to CF offsets (double)."""
    factor, reference = parse_units(units, calendar)
    return (to_micros(ts) - F.lit(bound_micros(reference))) / F.lit(factor)


def _plain_text(ts: Column) -> Column:
    """``2024-01-31 23:59:00`` with a fraction if there is one; needs no session zone."""
    return ts.cast("timestamp_ntz").cast("string")


def compact_time(ts: Column) -> Column:
    """``20240131T235900``, used in export names."""
    return F.translate(F.substring(_plain_text(ts), 1, 19), " -:", "T")


def time_text(ts: Column) -> Column:
    """Plot text of a time value, always with six fraction digits."""
    text = _plain_text(ts)
    return F.concat(F.substring(text, 1, 19), F.lit("."), F.rpad(F.substring(text, 21, 6), 6, "0"))


def year_month(ts: Column) -> Column:
    return F.substring(_plain_text(ts), 1, 7)


def whole_hour(ts: Column) -> Column:
    """The time cut to its hour, as wall time."""
    micros = to_micros(ts)
    return from_micros(micros - F.pmod(micros, F.lit(UNIT_MICROS["hour"])))
