"""Figures of daily records: DataFrames of (key, day, r), one row for every calendar day of a key.

Path figures use cumulative products as exp(sum(log1p)) over each key's days; returns are kept above -1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 365
#: What a record should reach.
TARGETS = {"avg_monthly": 0.015, "green": 0.7, "max_dd": -0.1, "sharpe": 1.0}


def safe(r: Column | str) -> Column:
    return F.greatest(r, F.lit(-0.999999))


def own() -> Window:
    return Window.partitionBy("key").orderBy("day")


def grown(r: Column | str) -> Column:
    """The product of 1 + r, as an aggregate."""
    return F.exp(F.sum(F.log1p(safe(r))))


def daily(bars: DataFrame, ts: str, r: str) -> DataFrame:
    """Returns compounded by UTC day (a stamp at midnight closes the day before), every day from first to last, 0 where none."""
    day = F.date_trunc("day", F.col(ts) - F.expr("INTERVAL 1 MICROSECOND"))
    made = bars.groupBy("key", day.alias("day")).agg((grown(F.coalesce(r, F.lit(0.0))) - 1).alias("r"))
    return every_day(made)


def every_day(record: DataFrame) -> DataFrame:
    span = record.groupBy("key").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    days = span.select("key", F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("day"))
    return days.join(record, ["key", "day"], "left").withColumn("r", F.coalesce("r", F.lit(0.0)))


def monthly(record: DataFrame) -> DataFrame:
    """(key, month, r) of complete calendar months."""
    span = Window.partitionBy("key")
    marked = record.withColumn("month", F.date_trunc("month", "day")).withColumn("lo", F.min("day").over(span)).withColumn("hi", F.max("day").over(span))
    whole = (F.col("month") >= F.col("lo")) & (F.last_day("month") <= F.to_date("hi"))
    return marked.where(whole).groupBy("key", "month").agg((grown("r") - 1).alias("r"))


def path(record: DataFrame) -> DataFrame:
    """record with equity, peak (the start counts) and drawdown."""
    out = record.withColumn("equity", F.exp(F.sum(F.log1p(safe("r"))).over(own())))
    out = out.withColumn("peak", F.greatest(F.max("equity").over(own()), F.lit(1.0)))
    return out.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def islands(df: DataFrame, flag: Column, order: str = "day") -> DataFrame:
    """(key, island, n): lengths of runs in which flag holds."""
    w = Window.partitionBy("key").orderBy(order)
    marked = df.withColumn("_flag", flag).withColumn("island", F.sum((~F.col("_flag")).cast("int")).over(w))
    return marked.where("_flag").groupBy("key", "island").agg(F.count(F.lit(1)).alias("n"))


def longest(df: DataFrame, flag: Column, name: str, order: str = "day") -> DataFrame:
    return islands(df, flag, order).groupBy("key").agg(F.max("n").alias(name))


def ratio(mean: Column, dev: Column) -> Column:
    return F.coalesce(mean / F.nullif(dev, F.lit(0.0)), F.lit(0.0))


def core(record: DataFrame) -> DataFrame:
    """One row per key: the figures of a daily record."""
    p = path(record)
    days = p.groupBy("key").agg(
        F.count(F.lit(1)).alias("days"), F.max_by("equity", "day").alias("growth"), F.min("drawdown").alias("max_dd"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"),
        F.sqrt(F.avg(F.pow(F.least("r", F.lit(0.0)), 2))).alias("down"), F.max("r").alias("best_day"), F.min("r").alias("worst_day"),
    )
    m = monthly(record)
    months = m.groupBy("key").agg(
        F.count(F.lit(1)).alias("months"), F.avg((F.col("r") > 0).cast("double")).alias("green"), F.avg((F.col("r") < 0).cast("double")).alias("red"),
        (F.count_if(F.col("r") > 0) / F.nullif(F.count_if(F.col("r") != 0), F.lit(0))).alias("green_active"), F.max("r").alias("best_month"), F.min("r").alias("worst_month"),
    )
    streak, under = longest(m, F.col("r") < 0, "red_streak", "month"), longest(p, F.col("drawdown") < 0, "underwater")
    out = days.join(months, "key", "left").join(streak, "key", "left").join(under, "key", "left").fillna(0, ["months", "red_streak", "underwater"])
    root = F.lit(float(YEAR) ** 0.5)
    return out.withColumns({
        "sharpe": ratio(F.col("mean"), F.col("sd")) * root, "sortino": ratio(F.col("mean"), F.col("down")) * root, "ann_vol": F.col("sd") * root,
        "cagr": F.pow("growth", YEAR / F.col("days")) - 1, "avg_monthly": F.when(F.col("growth") <= 0, -1.0).otherwise(F.pow("growth", YEAR / 12 / F.col("days")) - 1),
    }).drop("mean", "sd", "down")


def targets(card: DataFrame, portfolio: bool = False) -> DataFrame:
    """card with a boolean per target and how many are met; needs beats_hold."""
    green = F.col("green" if portfolio else "green_active")
    met = {
        "t_monthly": F.col("avg_monthly") >= TARGETS["avg_monthly"], "t_green": F.coalesce(green, F.lit(0.0)) >= TARGETS["green"],
        "t_drawdown": F.col("max_dd") >= TARGETS["max_dd"], "t_sharpe": F.col("sharpe") >= TARGETS["sharpe"], "t_hold": F.col("beats_hold"),
    }
    return card.withColumns(met).withColumn("targets_met", sum((F.col(c).cast("int") for c in met), F.lit(0)))


def k_ratio(record: DataFrame) -> DataFrame:
    """Slope of the log equity over its standard error, by root of a year, per day."""
    p = record.withColumn("y", F.sum(F.log1p(safe("r"))).over(own())).withColumn("x", F.row_number().over(own()).cast("double"))
    s = p.groupBy("key").agg(F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.count(F.lit(1)).alias("n"))
    slope = F.col("sxy") / F.col("sxx")
    se = F.sqrt((F.col("syy") - slope * F.col("sxy")) / (F.col("n") - 2) / F.col("sxx"))
    return s.select("key", (slope / F.nullif(se, F.lit(0.0)) * F.lit(float(YEAR) ** 0.5) / F.col("n")).alias("k_ratio"))


def equal_risk(record: DataFrame, benchmark: DataFrame, window: int = 90, most: float = 2.0, least: int = 30) -> DataFrame:
    """record with scale (yesterday's ratio of trailing deviations, at most `most`, 1 before `least` days) and sized."""
    both = record.join(benchmark.withColumnRenamed("r", "b"), ["key", "day"], "left").withColumn("b", F.coalesce("b", F.lit(0.0)))
    w = own().rowsBetween(-(window - 1), 0)
    k = F.when(F.count("r").over(w) >= least, F.stddev_samp("b").over(w) / F.nullif(F.stddev_samp("r").over(w), F.lit(0.0)))
    out = both.withColumn("_k", k).withColumn("scale", F.coalesce(F.least(F.lag("_k").over(own()), F.lit(most)), F.lit(1.0)))
    return out.withColumn("sized", F.col("r") * F.col("scale")).drop("_k")


def with_cash(r: str, gross: str, rf: str, spread: float = 0.015, margined: bool = False) -> Column:
    """A day's return with idle equity at the bill rate, and money borrowed past the equity at the rate and a yearly spread.

    A margined book keeps all of its equity in bills and borrows nothing.
    """
    idle = 1 - F.col(gross)
    return F.col(r) + F.col(rf) if margined else F.col(r) + idle * F.when(idle >= 0, F.col(rf)).otherwise(F.col(rf) + spread / YEAR)


def cagr(r: str) -> Column:
    return F.pow(grown(r), YEAR / F.count(F.lit(1))) - 1


def vs_hold(record: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, vs_hold): yearly growth of the record at the benchmark's risk less the benchmark's."""
    return equal_risk(record, benchmark).groupBy("key").agg((cagr("sized") - cagr("b")).alias("vs_hold"))


def best_year(record: DataFrame) -> DataFrame:
    """Average month with and without the best calendar year; null if under a year is left."""
    years = record.groupBy("key", F.year("day").alias("year")).agg((grown("r") - 1).alias("gain"), F.count(F.lit(1)).alias("n"), F.sum(F.log1p(safe("r"))).alias("log"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("gain"), "year"))
    ranked = years.withColumn("nth", nth)
    rest = F.sum(F.when(F.col("nth") > 1, F.col("log")))
    days = F.sum(F.when(F.col("nth") > 1, F.col("n")))
    month = lambda log, n: F.exp(log * (YEAR / 12) / n) - 1
    return ranked.groupBy("key").agg(
        F.max(F.when(F.col("nth") == 1, F.col("year"))).alias("year"), month(F.sum("log"), F.sum("n")).alias("avg_monthly"),
        F.when(days >= YEAR, month(rest, days)).alias("without"),
    )


def best_days_share(record: DataFrame, k: int = 5) -> DataFrame:
    log = record.withColumn("log", F.log1p(safe("r")))
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("log"), "day"))
    return log.withColumn("nth", nth).groupBy("key").agg((F.sum(F.when(F.col("nth") <= k, F.col("log"))) / F.nullif(F.sum("log"), F.lit(0.0))).alias("share"))


def deals(trades: DataFrame) -> DataFrame:
    """(key, n, win_rate, avg_win, avg_loss, profit_factor) of trades(key, r, size); a null size is 1."""
    made = F.col("r") * F.coalesce("size", F.lit(1.0))
    t = trades.withColumn("made", made)
    win, loss = F.when(F.col("made") > 0, F.col("made")), F.when(F.col("made") < 0, -F.col("made"))
    return t.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("made") > 0).cast("double")).alias("win_rate"), F.avg(win).alias("avg_win"), F.avg(loss).alias("avg_loss"),
        (F.sum(win) / F.nullif(F.sum(loss), F.lit(0.0))).alias("profit_factor"),
    )
