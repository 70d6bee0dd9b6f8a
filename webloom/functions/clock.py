"""Wall-clock times: every stored timestamp is a zone-less GMT+8 reading (F8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "+08:00"
PATTERN = "yyyy-MM-dd HH:mm:ss"


def format_wall(ts: Column) -> Column:
    """Stored wall-clock time as text; missing → ''."""
    return F.coalesce(F.date_format(ts, PATTERN), F.lit(""))


def naive(instant: Column) -> Column:
    """Instant → GMT+8 wall clock without zone."""
    return F.convert_timezone(F.current_timezone(), F.lit(ZONE), instant.cast("timestamp_ntz"))


def instant(wall: Column) -> Column:
    """GMT+8 wall clock → instant."""
    return F.convert_timezone(F.lit(ZONE), F.current_timezone(), wall).cast("timestamp")


def format_instant(ts: Column) -> Column:
    return format_wall(naive(ts))


def parse_time(text: Column) -> Column:
    """Wall clock from 'yyyy-MM-dd HH:mm:ss' or an RFC 3339 time; NULL when neither fits."""
    s = F.trim(text)
    plain = F.when(
        s.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?$"), s.try_cast("timestamp_ntz")
    )
    zoned = F.when(
        s.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), naive(s.try_cast("timestamp"))
    )
    return F.coalesce(plain, zoned)


def to_unix(wall: Column) -> Column:
    return F.coalesce(F.unix_seconds(instant(wall)), F.lit(0).cast("bigint"))


def from_unix(sec: Column) -> Column:
    return naive(F.timestamp_seconds(sec))


def start_of_day(wall: Column) -> Column:
    return F.date_trunc("DAY", wall).cast("timestamp_ntz")


def add_seconds(wall: Column, sec: Column) -> Column:
    return wall + F.make_dt_interval(secs=sec.cast("decimal(18,6)"))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Elapsed seconds with fraction between two wall-clock times."""
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def micros(wall: Column) -> Column:
    """Order key: epoch microseconds of a zone-less time read as UTC."""
    return F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), wall).cast("timestamp"))
