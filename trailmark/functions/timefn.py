"""Time columns: local time, parts of the day, gaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import _c, right_closed_bins


def local_time(utc, offset_minutes) -> Column:
    """UTC plus an offset in minutes; offsets that aren't numbers give null."""
    minutes = _c(offset_minutes).try_cast("int")
    return _c(utc) + F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0))


def parse_strict(text, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Timestamp; a text that doesn't fit is an error (ANSI mode)."""
    return F.to_timestamp(_c(text), fmt)


def parse_lenient(text, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.try_to_timestamp(_c(text), F.lit(fmt))


def weekday_name(time) -> Column:
    return F.date_format(_c(time), "EEEE")


def seconds_between(later: Column, earlier: Column) -> Column:
    """Difference in seconds with microseconds."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def _bins(hour: Column, bins, last: str) -> Column:
    out = None
    for lo, hi, name in bins:
        fits = (hour >= lo) & (hour < hi)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return F.when(hour.isNull(), None).otherwise(out.otherwise(last))


def part_of_day(time) -> Column:
    """Four bins, for session features."""
    return _bins(F.hour(_c(time)), ((5, 12, "morning"), (12, 17, "afternoon"), (17, 22, "evening")), "late_night")


def decision_time_bin(time) -> Column:
    """Five bins, for decision states; not those of part_of_day."""
    return _bins(F.hour(_c(time)), ((5, 11, "morning"), (11, 15, "midday"), (15, 19, "afternoon"), (19, 24, "evening")), "night")


def bin_hour(time_bin) -> Column:
    """Middle hour of a decision time bin; 12 for anything else."""
    b = _c(time_bin)
    return F.when(b == "morning", 8.0).when(b == "midday", 13.0).when(b == "afternoon", 17.0).when(b == "evening", 21.0).when(b == "night", 2.0).otherwise(12.0)


def is_weekend(time) -> Column:
    return (F.weekday(_c(time)) >= 5).cast("int")


def gap_bin(seconds, edges=(15, 30, 60, 120, 240)) -> Column:
    """Minutes since the last stop; BOS (beginning of session) where there is none."""
    return right_closed_bins(_c(seconds) / 60.0, edges, "min", "BOS")


def cyclic_hour(hour: Column) -> tuple[Column, Column]:
    angle = F.lit(2.0) * F.pi() * hour / 24.0
    return F.sin(angle), F.cos(angle)
