"""Working time (Monday to Friday, 08:00 to 18:00) as closed-form column expressions on timestamps without zone.

``index`` counts the working seconds from Monday 2000-01-03 to a time, so that a distance is a subtraction and
stays inside generated code. Valid from that day on.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAY_START, DAY_END = 8 * 3600, 18 * 3600
DAY = DAY_END - DAY_START
WEEK = 5 * DAY
MONDAY = "2000-01-03"


def _second_of_day(t: Column) -> Column:
    return F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def index(t: Column) -> Column:
    d = F.datediff(F.to_date(t), F.to_date(F.lit(MONDAY)))
    week, weekday = F.floor(d / 7), F.pmod(d, F.lit(7))
    today = F.when(weekday >= 5, 0).otherwise(F.least(F.greatest(_second_of_day(t), F.lit(DAY_START)), F.lit(DAY_END)) - DAY_START)
    return (week * WEEK + F.least(weekday, F.lit(5)) * DAY + today).cast("long")


def seconds_between(a: Column, b: Column) -> Column:
    """Working seconds from a to b; 0 if either is null or b isn't later."""
    return F.coalesce(F.when(b > a, index(b) - index(a)), F.lit(0).cast("long"))


def at_index(i: Column) -> Column:
    """The time inside a working day at which the index is reached."""
    days, within = F.floor(i / DAY), F.pmod(i, F.lit(DAY))
    date = F.date_add(F.to_date(F.lit(MONDAY)), (F.floor(days / 5) * 7 + F.pmod(days, F.lit(5))).cast("int"))
    return date.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (within + DAY_START).cast("decimal(18,6)"))


def plus_seconds(t: Column, n: int | Column) -> Column:
    return at_index(index(t) + n)


def off_hours(t: Column) -> Column:
    return (F.weekday(t) >= 5) | (F.hour(t) < 8) | (F.hour(t) >= 18)


def arrival_class(t: Column) -> Column:
    return F.when(F.weekday(t) >= 5, "weekend").when(off_hours(t), "night").otherwise("working")


def next_working_day(t: Column) -> Column:
    """Saturdays and Sundays moved to Monday, the time of day kept."""
    days = F.when(F.weekday(t) == 5, 2).when(F.weekday(t) == 6, 1).otherwise(0)
    return t + F.make_dt_interval(days)


def bucket(t: Column, unit: str = "day") -> Column:
    """The day, the week's Monday or the month's first; an unknown unit means days."""
    if unit == "week":
        return F.date_sub(F.to_date(t), F.weekday(t))
    return F.trunc(t, "MM") if unit == "month" else F.to_date(t)
