"""Bars on a common grid: alignment, masks, cleaning, gaps, resampling and periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def own() -> Window:
    return Window.partitionBy("instrument").orderBy("ts")
PRICES, FLOWS = ["open", "high", "low", "close"], ["volume", "dollar_volume"]


def clean_reason() -> Column:
    """Why a bar is dropped, the first reason that holds; null if it is kept."""
    return (
        F.when(F.greatest(*(F.col(c).isNull().cast("int") for c in PRICES)) == 1, "null_price")
        .when(F.least(*PRICES) <= 0, "not_positive")
        .when((F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")), "high_low")
    )


def clean(bars: DataFrame, order: str) -> DataFrame:
    """bars with a reason: of bars at one moment only the last in order is kept."""
    marked = bars.withColumn("reason", clean_reason()).withColumn("bad", F.col("reason").isNotNull())
    nth = F.row_number().over(Window.partitionBy("instrument", "ts", "bad").orderBy(F.desc(order)))
    return marked.withColumn("reason", F.when(~F.col("bad") & (nth > 1), "duplicate").otherwise(F.col("reason"))).drop("bad")


def grid(bars: DataFrame) -> DataFrame:
    """(instrument, ts): every instrument at every moment at which any printed."""
    return bars.select("ts").distinct().join(bars.select("instrument").distinct())


def aligned(bars: DataFrame) -> DataFrame:
    """Bars on the grid; what didn't print is null."""
    return grid(bars).join(bars, ["instrument", "ts"], "left")


def known(panel: DataFrame) -> DataFrame:
    """A missed bar shows the last close in all prices and nothing traded; nothing is filled before the first bar."""
    last = F.last("close", ignorenulls=True).over(own())
    out = panel.withColumn("last_close", last)
    filled = {c: F.coalesce(c, "last_close") for c in PRICES} | {c: F.coalesce(c, F.when(F.col("last_close").isNotNull(), 0.0)) for c in FLOWS}
    return out.withColumns(filled).drop("last_close")


def started(panel: DataFrame) -> DataFrame:
    return panel.withColumn("started", F.count("close").over(own()) > 0)


def ended(panel: DataFrame, days: int) -> DataFrame:
    """ended: after the last bar of a series that stops more than so many days before the panel does."""
    last = F.max(F.when(F.col("close").isNotNull(), F.col("ts"))).over(Window.partitionBy("instrument"))
    end = panel.agg(F.max("ts").alias("panel_end"))
    out = panel.withColumn("last_bar", last).join(F.broadcast(end))  # one row
    late = F.col("last_bar") < F.col("panel_end") - F.expr(f"INTERVAL {days} DAYS")
    return out.withColumn("ended", late & (F.col("ts") > F.col("last_bar"))).drop("last_bar", "panel_end")


def tradable(panel: DataFrame) -> DataFrame:
    """A bar that printed and isn't still: no volume and no move, in a series that ever has volume."""
    before = F.last("close", ignorenulls=True).over(own().rowsBetween(Window.unboundedPreceding, -1))
    ever = F.max("volume").over(Window.partitionBy("instrument")) > 0
    flat = (F.col("volume") == 0) & (F.col("open") == F.col("close")) & (F.col("high") == F.col("low")) & (F.col("close") == before)
    return panel.withColumn("tradable", F.col("open").isNotNull() & ~F.coalesce(ever & flat, F.lit(False)))


def missing_runs(panel: DataFrame, column: str = "close") -> DataFrame:
    """(instrument, first, last, bars) of runs of grid moments without a value, after the first and before the last bar."""
    seen = F.count(column).over(own())
    total = F.count(column).over(Window.partitionBy("instrument"))
    inner = panel.select("instrument", "ts", column, seen.alias("island"), total.alias("total")).where(F.col(column).isNull() & (F.col("island") > 0) & (F.col("island") < F.col("total")))
    return inner.groupBy("instrument", "island").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("bars")).drop("island")


def runs_of(df: DataFrame, flag: str) -> DataFrame:
    """df with island (counts the changes of flag) and nth (place in the island, from 1)."""
    change = F.coalesce((~F.col(flag).eqNullSafe(F.lag(flag).over(own()))).cast("int"), F.lit(1))
    out = df.withColumn("_change", change).withColumn("island", F.sum("_change").over(own())).drop("_change")
    return out.withColumn("nth", F.row_number().over(Window.partitionBy("instrument", "island").orderBy("ts")))


def resampled(bars: DataFrame, key: Column, stamp: Column | None = None, least: int = 1) -> DataFrame:
    """Bars of longer periods: first, greatest, least, last, sums; the stamp is the last bar's or given; thin periods go."""
    out = bars.withColumn("_key", key).groupBy("instrument", "_key").agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"), F.round(F.sum("dollar_volume"), 4).alias("dollar_volume"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_bars"),
    )
    return out.where(F.col("n_bars") >= least).withColumn("ts", F.col("last_ts") if stamp is None else stamp).drop("last_ts", "_key")


def session_day(ts: Column, zone: str, hour: int) -> Column:
    """The day whose session, begun at an hour of the evening before in a zone, a moment falls into."""
    return F.to_date(F.from_utc_timestamp(ts, zone) + F.expr(f"INTERVAL {24 - hour} HOURS"))


def in_fx_session(ts: Column, zone: str = "America/New_York") -> Column:
    """From Sunday 17:00 to Friday 17:00 on the zone's clock."""
    t = F.from_utc_timestamp(ts, zone)
    minute = (F.dayofweek(t) - 1) * 1440 + F.hour(t) * 60 + F.minute(t)
    return (minute >= 17 * 60) & (minute < 5 * 1440 + 17 * 60)


def period_start(ts: Column, every: str) -> Column:
    """Whether a bar is its instrument's first of a month ("M"), a week from Monday ("W") or n days of the epoch ("nD")."""
    if every == "M":
        key = F.date_format(ts, "yyyyMM").cast("int")
    elif every == "W":
        key = F.floor((F.datediff(F.to_date(ts), F.lit("1970-01-05").cast("date"))) / 7)
    else:
        key = F.floor(F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")) / int(every[:-1]))
    return ~key.eqNullSafe(F.lag(key).over(own()))


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored and those new bars that are newer than their instrument's last."""
    last = stored.groupBy("instrument").agg(F.max("ts").alias("last"))
    fresh = new.join(last, "instrument", "left").where(F.col("last").isNull() | (F.col("ts") > F.col("last"))).drop("last")
    return stored.unionByName(fresh)


def by_priority(*sources: DataFrame) -> DataFrame:
    """At each moment the bar of the first source that has one, with the source's number."""
    marked = [s.withColumn("source", F.lit(i)) for i, s in enumerate(sources)]
    out = marked[0]
    for m in marked[1:]:
        out = out.unionByName(m)
    nth = F.row_number().over(Window.partitionBy("instrument", "ts").orderBy("source"))
    return out.withColumn("_n", nth).where("_n = 1").drop("_n")
