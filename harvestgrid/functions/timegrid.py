"""Days, hours, calendar years and seasons.

A season runs from 1 April to 24 March and carries the year it starts in. Hourly values are
hour-ending: 1 January 00:00 belongs to the storage year before.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SEPARATORS = ("-", ".", "/", " ")


# --- days ---------------------------------------------------------------------------------------


def day_axis(start: Column, end: Column) -> Column:
    """All days from ``start`` to ``end``, both included, as an array."""
    return F.sequence(start.cast("date"), end.cast("date"), F.expr("interval 1 day"))


def parse_day(text: Column) -> Column:
    """DATE from year, month, day text with '-', '.', '/' or a space between; NULL otherwise."""
    return F.coalesce(
        *[F.try_to_timestamp(text, F.lit(f"yyyy{s}M{s}d")) for s in DAY_SEPARATORS]
    ).cast("date")


def parse_hour(text: Column, is_end: bool = False) -> Column:
    """Hourly bound ``day[Thour[:minute]]`` as TIMESTAMP_NTZ; NULL for anything else.

    Hour 24 is hour 0 of the next day, minutes over 30 round up, and a day alone means 01:00 for a
    start and 24:00 for an end.
    """
    parts = F.split(text, "T")
    clock = F.split(F.try_element_at(parts, F.lit(2)), ":")
    hour = F.try_element_at(clock, F.lit(1)).try_cast("int")
    minute = F.try_element_at(clock, F.lit(2)).try_cast("int")
    has_clock, has_minute = F.size(parts) > 1, F.size(clock) > 1
    hours = (
        F.when(~has_clock, F.lit(24 if is_end else 1))
        .when(has_minute & minute.isNull(), F.lit(None).cast("int"))
        .when(hour.between(0, 24), hour + F.when(has_minute & (minute > 30), 1).otherwise(0))
    )
    day = parse_day(F.element_at(parts, 1)).cast("timestamp_ntz")
    return day + F.make_dt_interval(F.lit(0), hours)


def day_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def is_leap(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def year_slices(start: Column, end: Column) -> Column:
    """The range cut by calendar year: array of (year, first, last) with 0-based day offsets."""

    def piece(year: Column) -> Column:
        new_year = F.make_date(year, F.lit(1), F.lit(1))
        first = F.greatest(start, new_year)
        last = F.least(end, F.make_date(year, F.lit(12), F.lit(31)))
        return F.struct(
            year.alias("year"),
            F.datediff(first, new_year).alias("first"),
            F.datediff(last, new_year).alias("last"),
        )

    return F.transform(F.sequence(F.year(start), F.year(end)), piece)


# --- hours --------------------------------------------------------------------------------------


def storage_year(ts: Column) -> Column:
    """Year whose file holds an hour-ending value."""
    return F.year(ts - F.expr("interval 1 hour"))


def storage_hour(ts: Column) -> Column:
    """0-based hour inside the storage year: 1 January 01:00 is 0."""
    began = ts - F.expr("interval 1 hour")
    return ((F.dayofyear(began) - 1) * 24 + F.hour(began)).cast("int")


def hour_slices(start: Column, end: Column) -> Column:
    """The range cut by storage year: array of (year, first, last) with 0-based hour offsets."""

    def piece(year: Column) -> Column:
        full = F.when(is_leap(year), 8783).otherwise(8759)
        return F.struct(
            year.alias("year"),
            F.when(year == storage_year(start), storage_hour(start)).otherwise(0).alias("first"),
            F.when(year == storage_year(end), storage_hour(end)).otherwise(full).alias("last"),
        )

    return F.transform(F.sequence(storage_year(start), storage_year(end)), piece)


def utc_to_local(ts: Column, zone: Column) -> Column:
    """UTC wall clock to a zone's wall clock (TIMESTAMP_NTZ); unchanged where the zone is NULL."""
    return F.coalesce(F.convert_timezone(F.lit("UTC"), zone, ts), ts)


def local_to_utc(ts: Column, zone: Column) -> Column:
    return F.coalesce(F.convert_timezone(zone, F.lit("UTC"), ts), ts)


# --- seasons ------------------------------------------------------------------------------------


def season_start(year: Column) -> Column:
    return F.make_date(year, F.lit(4), F.lit(1))


def season_end(year: Column) -> Column:
    return F.make_date(year + 1, F.lit(3), F.lit(24))


def season_year(day: Column) -> Column:
    """Season a day belongs to; NULL from 25 to 31 March.

    Seasons do not overlap, so joining days to seasons is an equi-join on this value.
    """
    month, number = F.month(day), F.dayofmonth(day)
    return F.when(month >= 4, F.year(day)).when((month < 3) | (number <= 24), F.year(day) - 1)


def in_season(day: Column, year: Column) -> Column:
    return day.between(season_start(year), season_end(year))


def day_of_season(day: Column) -> Column:
    """1-based day of the season; NULL outside."""
    return F.datediff(day, season_start(season_year(day))) + 1


# --- request ranges -----------------------------------------------------------------------------


def _day_value(value) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    for separator in DAY_SEPARATORS:
        if separator in value:
            return dt.datetime.strptime(value, separator.join(("%Y", "%m", "%d"))).date()
    raise ValueError(f"cannot read a day from {value!r}")


def _hour_value(value, is_end: bool) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        day, clock = value, ""
    else:
        text, _, clock = value.partition("T")
        day = _day_value(text)
    hour, _, minute = clock.partition(":")
    hours = int(hour) if clock else (24 if is_end else 1)
    if not 0 <= hours <= 24:
        raise ValueError(f"cannot read an hour from {value!r}")
    hours += int(minute.partition(":")[0] or 0) > 30
    return dt.datetime.combine(day, dt.time()) + dt.timedelta(hours=hours)


@dataclass(frozen=True)
class DayRange:
    """First and last day of a request, both included."""

    first: dt.date
    last: dt.date

    @classmethod
    def of(cls, first, last) -> "DayRange":
        return cls(_day_value(first), _day_value(last))

    @classmethod
    def around(cls, day, days: int = 64) -> "DayRange":
        """The days up to ``days`` before and after a reference day."""
        centre, margin = _day_value(day), dt.timedelta(days=days)
        return cls(centre - margin, centre + margin)

    @property
    def years(self) -> list[int]:
        return list(range(self.first.year, self.last.year + 1))

    def holds(self, day: Column) -> Column:
        return day.between(F.lit(self.first), F.lit(self.last))


@dataclass(frozen=True)
class HourRange:
    """First and last local hour of a request, both included."""

    first: dt.datetime
    last: dt.datetime

    @classmethod
    def of(cls, first, last) -> "HourRange":
        return cls(_hour_value(first, False), _hour_value(last, True))

    @property
    def years(self) -> list[int]:
        hour = dt.timedelta(hours=1)
        return list(range((self.first - hour).year, (self.last - hour).year + 1))

    def holds(self, ts: Column) -> Column:
        def literal(value: dt.datetime) -> Column:
            return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")

        return ts.between(literal(self.first), literal(self.last))
