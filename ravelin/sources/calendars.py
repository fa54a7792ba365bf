"""Trading calendars as tables: sessions of the New York exchange by rule."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = "America/New_York"


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th weekday (Monday is 0) of a month; n = -1: the last."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
    return last - timedelta((last.weekday() - weekday) % 7)


def _easter(year: int) -> date:
    """Sunday of Easter by the Gregorian rule."""
    golden, century = year % 19, year // 100
    skipped, moon = 3 * century // 4 - 12, (8 * century + 5) // 25 - 5
    epact = (11 * golden + 20 + moon - skipped) % 30
    epact += 1 if epact == 24 or (epact == 25 and golden + 1 > 11) else 0
    full = 44 - epact
    full += 30 if full < 21 else 0
    sunday = full + 7 - (5 * year // 4 - skipped - 10 + full) % 7
    return date(year, 3, 1) + timedelta(sunday - 1)


def _observed(day: date, saturday: bool = True) -> date | None:
    """Sundays move to Monday; Saturdays to Friday, or aren't kept."""
    if day.weekday() == 6:
        return day + timedelta(1)
    return (day - timedelta(1) if saturday else None) if day.weekday() == 5 else day


def holidays(year: int) -> set[date]:
    out = {_observed(date(year, 1, 1), False), _nth(year, 2, 0, 3), _easter(year) - timedelta(2), _nth(year, 5, 0, -1), _observed(date(year, 7, 4)), _nth(year, 9, 0, 1), _nth(year, 11, 3, 4), _observed(date(year, 12, 25))}
    out |= {_nth(year, 1, 0, 3)} if year >= 1998 else set()
    out |= {_observed(date(year, 6, 19))} if year >= 2022 else set()
    return out - {None}


def early_closes(year: int) -> set[date]:
    """Days that end at 13:00: before Independence Day and Christmas, and after Thanksgiving."""
    days = {date(year, 7, 3), date(year, 12, 24), _nth(year, 11, 3, 4) + timedelta(1)}
    return {d for d in days if d.weekday() < 5 and d not in holidays(year)}


def sessions(spark: SparkSession, first: int, last: int) -> DataFrame:
    """(day, open, close) in UTC for whole years: some 252 rows each."""
    rows = []
    for year in range(first, last + 1):
        shut, early = holidays(year), early_closes(year)
        for i in range(366):
            d = date(year, 1, 1) + timedelta(i)
            if d.year == year and d.weekday() < 5 and d not in shut:
                rows.append((d, 13 if d in early else 16))
    at = lambda h, m: F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", "day", F.format_string("%02d:%02d:00", h, m))), ZONE)
    df = spark.createDataFrame(rows, "day date, hour int")
    return df.select("day", at(F.lit(9), F.lit(30)).alias("open"), at(F.col("hour"), F.lit(0)).alias("close"))


def in_session(bars: DataFrame, days: DataFrame, start: str) -> DataFrame:
    """bars that start within a session, with its day, open and close: an equality join on the day in New York."""
    return bars.withColumn("day", F.to_date(F.from_utc_timestamp(start, ZONE))).join(days, "day").where((F.col(start) >= F.col("open_at")) & (F.col(start) < F.col("close_at")))
