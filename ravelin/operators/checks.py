"""The data check: what is missing or odd in the series that a list holds.

bars: instrument, ts (days) and prices; held: instrument, ts, listed. A finding is (instrument, kind, n, held, recent): held is how
many held days it touches, recent those of the last year.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.operators.panel import own, runs_of

#: Days of grace at either end, days that count as recent, a stopped series' silence, a long hole's weekdays.
SLACK, RECENT, STOPPED, LONG_HOLE, PAUSE = 4, 365, 7, 10, 5


def days_after(c: Column | str, n: int) -> Column:
    return F.timestamp_seconds(F.unix_seconds(c) + n * 86400)


def expected_weekdays(spans: DataFrame) -> DataFrame:
    """(instrument, ts): weekdays from lo to hi without Christmas and New Year. spans: instrument, lo, hi."""
    days = spans.select("instrument", F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("ts"))
    feast = F.date_format("ts", "MM-dd").isin("12-25", "01-01")
    return days.where(F.dayofweek("ts").between(2, 6) & ~feast)


def holes(bars: DataFrame) -> DataFrame:
    """(instrument, lo, hi, n): runs of expected weekdays without a bar, between a series' first and last."""
    span = bars.groupBy("instrument").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    have = bars.select("instrument", "ts").distinct().withColumn("have", F.lit(True))
    days = expected_weekdays(span).join(have, ["instrument", "ts"], "left").withColumn("gone", F.col("have").isNull())
    runs = runs_of(days, "gone").where("gone").groupBy("instrument", "island")
    return runs.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count(F.lit(1)).alias("n")).drop("island")


def held_inside(spans: DataFrame, held: DataFrame) -> DataFrame:
    """spans(instrument, lo, hi, ...) with held and recent, the held days inside each.

    Held days are numbered in order; a span's count is a difference of two as-of lookups, so nothing is joined by range.
    """
    from ravelin.operators.joins import as_of

    last = F.broadcast(held.agg(F.max("ts").alias("last_day")))  # one row
    days = held.where("listed").select("instrument", "ts").distinct().join(last)
    recent = F.sum((F.col("ts") >= days_after("last_day", -RECENT)).cast("long")).over(own())
    days = days.select("instrument", "ts", F.row_number().over(own()).cast("long").alias("so_far"), recent.alias("recent_so_far"))
    up = as_of(spans, days, "instrument", "hi", "ts", ["so_far", "recent_so_far"]).withColumnsRenamed({"so_far": "_a", "recent_so_far": "_b"}).drop("value_ts")
    low = as_of(up, days, "instrument", "lo", "ts", ["so_far", "recent_so_far"], strict=True).drop("value_ts")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return low.withColumn("held", zero("_a") - zero("so_far")).withColumn("recent", zero("_b") - zero("recent_so_far")).drop("_a", "_b", "so_far", "recent_so_far")


def findings(bars: DataFrame, held: DataFrame) -> DataFrame:
    """Every finding of a list's daily series: missing ends, stopped, joined markets, dead runs, long holes of its own or shared ones."""
    ends = held.agg(F.min("ts").alias("first_day"), F.max("ts").alias("last_day"))
    span = bars.groupBy("instrument").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    ever = held.where("listed").select("instrument").distinct()
    s = ever.join(span, "instrument", "left").join(F.broadcast(ends))  # one row
    before = s.where("lo IS NOT NULL").select("instrument", F.lit("missing").alias("kind"), F.col("first_day").alias("a"), days_after("lo", -SLACK).alias("b"))
    after = s.where("lo IS NOT NULL").select("instrument", F.lit("missing").alias("kind"), days_after("hi", SLACK).alias("a"), F.col("last_day").alias("b"))
    none = s.where("lo IS NULL").select("instrument", F.lit("missing").alias("kind"), F.col("first_day").alias("a"), F.col("last_day").alias("b"))
    still = F.coalesce(F.col("volume") == 0, F.lit(True)) & (F.col("close") == F.lag("close").over(own()))
    dead = runs_of(bars.withColumn("still", F.coalesce(still, F.lit(False))), "still").where("still").groupBy("instrument", "island").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("n"))
    dead = dead.where(F.col("n") >= LONG_HOLE).select("instrument", F.lit("dead").alias("kind"), "a", "b")
    gaps = held_inside(holes(bars).join(ever, "instrument", "left_semi"), held).where("held > 0")
    many = F.sum(F.when(F.col("n") <= LONG_HOLE, F.col("n"))).over(Window.partitionBy("instrument"))
    long_ = gaps.withColumn("many", F.coalesce(many, F.lit(0))).where((F.col("n") > LONG_HOLE) | (F.col("many") > LONG_HOLE))
    names = F.broadcast(s.where("lo IS NOT NULL").agg(F.count(F.lit(1)).alias("names")))  # one row
    long_ = long_.withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("lo", "hi"))).join(names)
    shared = F.col("same") >= F.greatest(F.lit(3), F.col("names") / 2)
    own_holes = long_.where(~shared).groupBy("instrument").agg(F.lit("holes").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("held").alias("held"), F.sum("recent").alias("recent"))
    common = long_.where(shared).select(F.lit("most of the list").alias("instrument"), F.lit("shared hole").alias("kind"), "n", "lo", "hi").distinct().select("instrument", "kind", "n", F.lit(0).cast("long").alias("held"), F.lit(0).cast("long").alias("recent"))
    spans = reduce(DataFrame.unionByName, (before, after, none, dead)).where("a <= b")
    touched = held_inside(spans.withColumnsRenamed({"a": "lo", "b": "hi"}), held).where("held > 0")
    touched = touched.groupBy("instrument", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("held").alias("held"), F.sum("recent").alias("recent"))
    stopped = s.where(F.col("last_day") > days_after("hi", STOPPED)).select("instrument", F.lit("stopped").alias("kind"), F.datediff("last_day", "hi").cast("long").alias("n"), F.lit(0).cast("long").alias("held"), F.lit(0).cast("long").alias("recent"))
    traded = bars.where("volume > 0").join(ever, "instrument", "left_semi")
    moved = F.col("open") / F.lag("close").over(own())
    joined = traded.withColumn("pause", F.datediff("ts", F.lag("ts").over(own()))).withColumn("moved", moved).where((F.col("pause") > PAUSE) & ~F.col("moved").between(0.5, 2.0))
    joined = joined.groupBy("instrument").agg(F.lit("joined").alias("kind"), F.count(F.lit(1)).alias("n")).withColumn("held", F.lit(0).cast("long")).withColumn("recent", F.lit(0).cast("long"))
    return reduce(DataFrame.unionByName, (touched, own_holes, common, stopped, joined))
