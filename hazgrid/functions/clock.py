"""Weeks, service times and epochs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds from the Unix epoch to 2001-01-01.
EPOCH_2001 = 978_307_200
WEEKS = 52


def week_of_year(day: Column) -> Column:
    """Weeks of seven days from 1 January, 0 to 51 (the last takes the rest of the year); not ISO weeks."""
    return F.least(F.floor((F.dayofyear(day) - 1) / 7), F.lit(51)).cast("int")


def week_distance(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, WEEKS - d)


def service_seconds(text: Column) -> Column:
    """Seconds of HH:MM:SS, hours past 24 allowed up to 168; null for anything else."""
    pattern = r"^\s*(\d{1,3}):(\d{1,2}):(\d{1,2})\s*$"
    h, m, s = (F.try_to_number(F.regexp_extract(text, pattern, i), F.lit("999")).cast("int") for i in (1, 2, 3))
    return F.when(text.rlike(pattern) & (m < 60) & (s < 60) & (h <= 168), h * 3600 + m * 60 + s)


def service_time(seconds: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600).cast("int"), F.floor(seconds % 3600 / 60).cast("int"), (seconds % 60).cast("int"))


def unix_seconds(since_2001: Column) -> Column:
    return since_2001 + EPOCH_2001


def weekday(day: Column) -> Column:
    """Monday 0 to Sunday 6."""
    return F.weekday(day)


def decay(age: Column, half_life: float) -> Column:
    """The share left after ``age``; time that runs back leaves all."""
    return F.pow(F.lit(2.0), -F.greatest(age, F.lit(0.0)) / half_life)


#: Seconds from a service day's noon back to its start, and the least and greatest year of one.
HALF_DAY, FIRST_YEAR, LAST_YEAR = 43_200, 1900, 2100
#: Seconds that an earlier day's start may be off whole days by, and the hour past which a stored time can't be.
DRIFT, LAST_HOUR = 7_200, 169


def day_start(service_date: Column, zone: Column) -> Column:
    """Seconds since 1970 at which the service day YYYYMMDD begins: twelve hours before noon in its zone, which isn't midnight on
    the days that the clocks change. Null for what is no day. ``zone`` may differ by row; a zone must be a known one."""
    day = F.try_to_date(F.lpad(service_date.cast("string"), 8, "0"), "yyyyMMdd")
    noon = F.to_utc_timestamp(F.timestamp_seconds(F.unix_date(day).cast("long") * 86_400 + HALF_DAY), zone)
    year = F.floor(service_date / 10_000)
    return F.when(day.isNotNull() & year.between(FIRST_YEAR, LAST_YEAR), F.unix_seconds(noon) - HALF_DAY)


def day_starts(service_date: Column, zone: Column, days: int) -> Column:
    """array<long>: seconds from the start of each of the ``days`` days before a service day to its own; whole days where any
    is off by over two hours, or the day is none."""
    today = day_start(service_date, zone)
    day = F.try_to_date(F.lpad(service_date.cast("string"), 8, "0"), "yyyyMMdd")
    before = [today - day_start(F.date_format(F.date_sub(day, k), "yyyyMMdd").cast("int"), zone) for k in range(1, days + 1)]
    whole = F.array(*(F.lit(86_400 * k).cast("long") for k in range(1, days + 1)))
    sound = F.lit(True)
    for k, b in enumerate(before, 1):
        sound = sound & F.coalesce(F.abs(b - 86_400 * k) <= DRIFT, F.lit(False))
    return F.when(sound, F.array(*before)).otherwise(whole)


def zone_shift(service_date: Column, zone: Column, reference: Column) -> Column:
    """Seconds to add to times of a feed in ``zone`` so that they read in the clock of ``reference`` on a service day."""
    return day_start(service_date, zone) - day_start(service_date, reference)


def service_instant(service_date: Column, zone: Column, seconds: Column) -> Column:
    """Seconds since 1970 of a stored time, which may lie past 24 hours, up to a week and its last hour; null for others."""
    return F.when((seconds >= 0) & (seconds < LAST_HOUR * 3600), day_start(service_date, zone) + seconds)
