"""Joins in time: as-of, interval and span joins, without cross products.

As-of joins are a union of both sides and a running last value per key, so one shuffle on the key serves them and the
cost is that of a sort. Interval joins attach each event to the first bar at or after it in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def unions_dealt_anew(spark: SparkSession) -> None:
    """From now on the session deals the rows of a union anew where a key is asked for.

    Spark 4.1 takes a union of frames that are dealt by one key for dealt by it too, and then coalesces the partitions of each
    frame by its own sizes, so rows of one key come to lie in different tasks.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def stacked(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """The rows of both, for what asks for a key's rows together."""
    unions_dealt_anew(top.sparkSession)
    return top.unionByName(bottom)


def as_of(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str], strict: bool = False) -> DataFrame:
    """left with the values of right's last row of the key at or before (strict: before) its moment."""
    shape = F.struct(F.col(right_ts).alias("_at"), *values)
    events = right.select(key, F.col(right_ts).alias("_ts"), F.lit(1 if strict else 0).alias("_order"), shape.alias("_value"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_row"))
    asks = left.select(key, F.col(left_ts).alias("_ts"), F.lit(0 if strict else 1).alias("_order"), F.lit(None).cast(events.schema["_value"].dataType).alias("_value"), F.struct("*").alias("_row"))
    w = Window.partitionBy(key).orderBy("_ts", "_order").rowsBetween(Window.unboundedPreceding, 0)
    found = stacked(events, asks).withColumn("_last", F.last("_value", ignorenulls=True).over(w)).where("_row IS NOT NULL")
    return found.select("_row.*", *(F.col(f"_last.{v}").alias(v) for v in values), F.col("_last._at").alias("value_ts"))


def next_bar(events: DataFrame, bars: DataFrame, key: str, event_ts: str, values: list[str]) -> DataFrame:
    """events with bar_ts: the first bar of the key at or after the event, null if there is none."""
    asks = events.select(key, F.col(event_ts).alias("_ts"), F.lit(1).alias("_order"), F.lit(None).cast("timestamp").alias("_bar"), F.struct(event_ts, *values).alias("_row"))
    at = bars.select(key, F.col("ts").alias("_ts"), F.lit(0).alias("_order"), F.col("ts").alias("_bar"), F.lit(None).cast(asks.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(key).orderBy(F.desc("_ts"), F.asc("_order")).rowsBetween(Window.unboundedPreceding, 0)
    return stacked(asks, at).withColumn("bar_ts", F.last("_bar", ignorenulls=True).over(w)).where("_row IS NOT NULL").select(key, "_row.*", "bar_ts")


def months_back(df: DataFrame, key: str, value: str, months: int, out: str) -> DataFrame:
    """The value at or before the same date so many months back."""
    asks = df.withColumn("_then", F.col("ts") - F.make_interval(months=F.lit(months)))
    past = df.where(F.col(value).isNotNull()).select(key, F.col("ts").alias("_past"), F.col(value).alias(out))
    return as_of(asks, past, key, "_then", "_past", [out]).drop("_then", "value_ts")


def trailing_sum(value: str, ts: str, days: int, key: str = "instrument") -> Column:
    """Sum over the last days, the moment of `days` ago left out."""
    seconds = F.unix_seconds(ts)
    return F.sum(value).over(Window.partitionBy(key).orderBy(seconds).rangeBetween(-days * 86400 + 1, 0))


def spans_of_events(events: DataFrame, key: str, ts: str, added: str) -> DataFrame:
    """(key, start, end) from events that add or remove; an open span has no end. Repeated events of one kind count once."""
    w = Window.partitionBy(key).orderBy(ts)
    change = events.withColumn("_before", F.lag(added).over(w)).where(F.coalesce(F.col("_before") != F.col(added), F.col(added)))
    paired = change.withColumn("end", F.lead(ts).over(w)).where(added)
    return paired.select(key, F.col(ts).alias("start"), "end")
