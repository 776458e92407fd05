"""Time expressions on TIMESTAMP_NTZ columns; none depends on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a UTC wall-clock time."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts) if isinstance(ts, str) else ts)


def seconds_between(a: str, b: str) -> Column:
    """b - a in seconds, as a double."""
    return F.timestamp_diff("MICROSECOND", F.col(a), F.col(b)) / 1e6


def floor_to(ts: str, unit_micros: int) -> Column:
    return F.timestamp_add("MICROSECOND", F.negative(F.pmod(micros(ts), F.lit(unit_micros))), F.col(ts))


def week_start(ts: str) -> Column:
    return F.date_sub(F.col(ts).cast("date"), F.weekday(F.col(ts).cast("date")))


def local_to_utc(ts: Column, zone: str, second: Column | None = None) -> Column:
    """UTC of a local time. A time that the clocks skip becomes the first one after the gap (gaps begin at a full hour and
    last an hour at most); one that comes twice is the first, or the second where `second` is true."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)
    back = utc_to_local(utc, zone)
    late = F.timestamp_diff("MICROSECOND", F.date_trunc("HOUR", ts).cast("timestamp_ntz"), ts)
    out = F.when(back != ts, F.timestamp_add("MICROSECOND", F.negative(late), utc)).otherwise(utc)
    if second is None:
        return out
    later = F.timestamp_add("HOUR", F.lit(1), utc)
    return F.when(second & is_ambiguous(ts, zone), later).otherwise(out)


def is_ambiguous(ts: Column, zone: str) -> Column:
    """True for local times that come twice: an hour later in UTC the clock shows the same."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)
    return utc_to_local(F.timestamp_add("HOUR", F.lit(1), utc), zone) == ts


def utc_to_local(ts: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def not_nan(c: str | Column) -> Column:
    """NaN as NULL: Spark counts NaN greater than any number, and its aggregates don't skip it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)
