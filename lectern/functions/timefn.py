"""Time columns.

Event times are kept as wall-clock timestamps of the warehouse's zone (``TIMESTAMP_NTZ``), made
once at ingest from epoch numbers, so a calendar day is a plain ``to_date`` and no later step
depends on the session time zone. Streams need ``TIMESTAMP`` for watermarks and convert at entry.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Output formats for days and times.
DATE_FORMAT = "yyyy-MM-dd"
DATETIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
DATE_NUMBER_FORMAT = "yyyyMMdd"

# Times inside JSON text keep their microseconds.
JSON_TIMES = {
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wall_clock(utc: Column, tz: str) -> Column:
    """Shift a UTC wall-clock timestamp into ``tz``."""
    return utc if tz == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def from_millis(millis: Column | str, tz: str = "UTC") -> Column:
    """Epoch milliseconds -> wall-clock timestamp in ``tz``."""
    m = col(millis).cast("bigint")
    return wall_clock(F.timestamp_add("MILLISECOND", m, F.expr(_EPOCH)), tz)


def from_seconds(seconds: Column | str, tz: str = "UTC") -> Column:
    """Epoch seconds -> wall-clock timestamp in ``tz``."""
    return from_millis(col(seconds).cast("bigint") * 1000, tz)


def micros(ts: Column | str) -> Column:
    """Wall-clock timestamp -> microseconds since the epoch, as a long."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), col(ts).cast("timestamp_ntz"))


def to_millis(ts: Column | str, tz: str = "UTC") -> Column:
    """Wall-clock timestamp in ``tz`` -> epoch milliseconds."""
    t = col(ts).cast("timestamp_ntz")
    utc = t if tz == "UTC" else F.convert_timezone(F.lit(tz), F.lit("UTC"), t)
    return F.timestamp_diff("MILLISECOND", F.expr(_EPOCH), utc)


def day(ts: Column | str) -> Column:
    return F.to_date(col(ts))


def date_text(ts: Column | str) -> Column:
    return F.date_format(col(ts), DATE_FORMAT)


def datetime_text(ts: Column | str) -> Column:
    return F.date_format(col(ts), DATETIME_FORMAT)


def date_text_to_millis(text: Column | str, tz: str = "UTC") -> Column:
    """``yyyy-MM-dd`` text, midnight in ``tz`` -> epoch milliseconds."""
    return to_millis(F.to_date(col(text), DATE_FORMAT), tz)


def date_number(ts: Column | str) -> Column:
    """The integer date ``yyyyMMdd`` that report callers pass."""
    return F.date_format(col(ts), DATE_NUMBER_FORMAT).cast("int")


def whole_seconds(ts: Column | str) -> Column:
    """Row time of the keyword job: the fraction of a second is cut off."""
    return F.date_trunc("second", col(ts)).cast("timestamp_ntz")


def hour_label(hour: Column | str) -> Column:
    """0 -> '00' ... 23 -> '23'."""
    return F.lpad(col(hour).cast("string"), 2, "0")


def version_time(text: Column | str) -> Column:
    """Row-version text such as ``2022-04-01 11:10:55.04Z`` as a comparable timestamp."""
    return F.try_to_timestamp(F.rtrim(col(text)))


def is_newer_version(left: Column | str, right: Column | str) -> Column:
    return version_time(left) > version_time(right)


def as_instant(ts: Column | str) -> Column:
    """Wall-clock timestamp -> ``TIMESTAMP`` for stream watermarks, whatever the session zone."""
    return F.timestamp_micros(micros(ts))


def from_micros(at: Column | str) -> Column:
    """Microseconds since the epoch -> wall-clock timestamp."""
    return F.timestamp_add("MICROSECOND", col(at), F.expr(_EPOCH))
