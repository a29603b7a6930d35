"""Time values as microseconds since 1970 UTC: epochs, text formats, zones.

Text is decoded against an explicit offset, so results do not depend on the session's
time zone. Values are Columns; zones given as text in a column are resolved per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (scale to seconds, seconds from 1970 to the epoch's zero).
EPOCHS = {
    "unix_s": (1.0, 0.0),
    "unix_ms": (1e-3, 0.0),
    "unix_us": (1e-6, 0.0),
    "unix_ns": (1e-9, 0.0),
    "cocoa": (1.0, 978307200.0),
    "webkit": (1e-6, -11644473600.0),
}
_DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss",
    "f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM", "j": "DDD", "a": "E", "A": "EEEE",
}
_OFFSET = r"([zZ]|[+-]\d{2}:?\d{2}|[+-]\d{2})$"
_TIMED_OFFSET = r"\d{2}:?\d{2}.*([zZ]|[+-]\d{2}:?\d{2}|[+-]\d{2})$"
HOUR_US = 3_600_000_000


def epoch_us(value: Column, epoch: str) -> Column:
    """Microseconds of a number in a named epoch, rounded half to even; text that is no number fails."""
    if epoch not in EPOCHS:
        raise ValueError(f"unknown epoch {epoch!r}")
    factor, offset = EPOCHS[epoch]
    return F.rint((value.cast("double") * F.lit(factor) + F.lit(offset)) * F.lit(1e6)).cast("long")


def whole_us(value: Column) -> Column:
    return value.cast("long")


def spark_pattern(fmt: str) -> tuple[str, bool]:
    """The pattern of a strptime format (without %z), and whether it has %z at its end."""
    out, at, offset = [], 0, False
    while at < len(fmt):
        c = fmt[at]
        if c == "%" and at + 1 < len(fmt):
            d = fmt[at + 1]
            at += 2
            if d == "z" and at == len(fmt):
                offset = True
            elif d == "%":
                out.append("'%'")
            elif d in _DIRECTIVES:
                out.append(_DIRECTIVES[d])
            else:
                raise ValueError(f"format directive %{d} is not supported here")
            continue
        literal = re.match(r"[^%]+", fmt[at:])[0]
        out.append("''".join(f"'{part}'" if re.search("[A-Za-z]", part) else part for part in literal.split("'")))
        at += len(literal)
    return "".join(out), offset


def offset_hours(suffix: Column) -> Column:
    """Hours of an offset such as +02:00, -0530, +02 or Z."""
    digits = F.regexp_replace(suffix, "[^0-9]", "")
    hours = F.substring(digits, 1, 2).try_cast("double") + F.coalesce(F.substring(digits, 3, 2).try_cast("double"), F.lit(0.0)) / 60
    return F.when(F.lower(suffix) == "z", F.lit(0.0)).otherwise(F.when(F.substring(suffix, 1, 1) == "-", -hours).otherwise(hours))


def _instant_us(text: Column, pattern: str) -> Column:
    return F.unix_micros(F.to_timestamp(F.concat(text, F.lit(" +0000")), f"{pattern} xx"))


def strptime_us(value: Column, fmt: str) -> tuple[Column, Column]:
    """(wall-clock microseconds, offset hours or null) of text in a strptime format; other text fails."""
    pattern, has_offset = spark_pattern(fmt)
    text = value.cast("string")
    if not has_offset:
        return _instant_us(text, pattern), F.lit(None).cast("double")
    suffix = F.regexp_extract(text, _OFFSET, 1)
    body = F.regexp_replace(text, _OFFSET, "")
    return _instant_us(F.rtrim(body) if pattern.rstrip() == pattern else body, pattern), F.when(suffix != "", offset_hours(suffix))


def iso_us(value: Column) -> tuple[Column, Column]:
    """(wall-clock microseconds, offset hours or null) of ISO-8601 text; other text is null.

    The basic form without separators, decimal commas, and dates that end at the month or
    year are read too.
    """
    text = F.trim(value.cast("string"))
    text = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])", "$1-$2-$3")
    text = F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})(\d{2})(\d{2})?(?=$|[.,Zz+-])", "$1:$2:0$3")
    text = F.regexp_replace(F.regexp_replace(text, r"^(.{16}):0(\d{2})(?!\d)", "$1:$2"), r"^(.{16}):0(?!\d)", "$1:00")
    text = F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}),(\d)", "$1.$2")
    text = F.regexp_replace(F.regexp_replace(text, r"^(\d{4})$", "$1-01"), r"^(\d{4}-\d{2})$", "$1-01")
    timed = F.rlike(text, F.lit(_TIMED_OFFSET)) & ~F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}$"))
    suffix = F.when(timed, F.regexp_extract(text, _OFFSET, 1))
    body = F.when(timed, F.regexp_replace(text, _OFFSET, "")).otherwise(text)
    dated = F.when(F.rlike(body, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.concat(body, F.lit("T00:00:00"))).otherwise(body)
    us = F.unix_micros(F.concat(F.rtrim(dated), F.lit("Z")).try_cast("timestamp"))
    return F.when(F.rlike(text, F.lit(r"^\d{4}-")), us), offset_hours(suffix)


def zone_offset(token: Column) -> Column:
    """Base offset in hours of a zone token: UTC+02:00, GMT, Z, a number; null for none, `local` and the rest."""
    text = F.trim(F.regexp_replace(F.coalesce(token.cast("string"), F.lit("")), r"(?i)\[dst\]", ""))
    text = F.trim(F.regexp_replace(text, r"(?i)^(utc|gmt)", ""))
    sign = F.regexp_extract(text, r"^([+-])\s*(\d{1,2})(?::?(\d{2}))?$", 1)
    hours = F.regexp_extract(text, r"^([+-])\s*(\d{1,2})(?::?(\d{2}))?$", 2).try_cast("double")
    minutes = F.coalesce(F.regexp_extract(text, r"^([+-])\s*(\d{1,2})(?::?(\d{2}))?$", 3).try_cast("double"), F.lit(0.0))
    named = F.rlike(F.trim(token.cast("string")), F.lit(r"(?i)^(utc|gmt|z)(\s*\[dst\])?$"))
    return (
        F.when(named, F.lit(0.0))
        .when(sign != "", F.when(sign == "-", -(hours + minutes / 60)).otherwise(hours + minutes / 60))
        .otherwise(text.try_cast("double"))
    )


def zone_is_local(token: Column) -> Column:
    """Whether a zone token stands for local time with its clock changes."""
    return F.coalesce(F.rlike(token.cast("string"), F.lit(r"(?i)\[dst\]|^\s*local\s*$")), F.lit(False))


def standard_offset(zone: str) -> float:
    """Hours that a zone is ahead of UTC when its summer time is off (in January or July of 2025)."""
    from datetime import datetime, timedelta
    from zoneinfo import ZoneInfo

    probes = [datetime(2025, month, 15, tzinfo=ZoneInfo(zone)) for month in (1, 7)]
    plain = [p for p in probes if not p.dst()] or probes
    return plain[0].utcoffset() / timedelta(hours=1)


def local_to_utc_us(wall_us: Column, zone: str | Column) -> Column:
    """The instant of a wall clock in an IANA zone: the earlier of two, and past a gap by the offset before it."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall_us), zone))


def offset_at(us: Column, zone: str | Column) -> Column:
    """Hours that a zone is ahead of UTC at an instant."""
    return (F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone)) - us) / F.lit(float(HOUR_US))


def wall_clock_anomaly(wall_us: Column, zone: str | Column) -> Column:
    """'gap' for a wall clock that the zone skips, 'overlap' for one it has twice, else null."""
    utc = local_to_utc_us(wall_us, zone)
    back = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc), zone))
    later = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc + HOUR_US), zone))
    return F.when(back != wall_us, "gap").when(later == wall_us, "overlap")
