"""Canonical views: bars, ticks, settlements and dividends over the star schema.

A bar is (instrument, ts, open, high, low, close, volume, dollar_volume). Prices are l_extendedprice / l_quantity, taken in
order of l_orderkey, l_linenumber and l_partkey within a day; ticks are ordered by one long, so bars are hash aggregates. Dimension joins leave the choice of broadcasting to the optimizer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["open", "high", "low", "close", "volume", "dollar_volume"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ohlcv(ticks: DataFrame, *keys: str, price: str = "price", order: str = "tick", volume: str = "size", money: str = "money") -> DataFrame:
    """First, greatest, least and last price, and sums, by keys. One partial and one final aggregate, no window."""
    p, o = F.col(price), F.col(order)
    return ticks.groupBy(*keys).agg(
        F.min_by(p, o).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, o).alias("close"),
        F.sum(volume).alias("volume"), F.round(F.sum(money), 4).alias("dollar_volume"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tick per line: l_partkey, l_suppkey, ts (the day), price, size, money, and tick, its order."""
    return table(spark, sf_dir, "lineitem").where("l_quantity > 0").select(
        "l_partkey", "l_suppkey", F.date_trunc("day", F.col("l_shipdate").cast("timestamp")).alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"), F.col("l_extendedprice").alias("money"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey") % 1_000_000).alias("tick"),
    )


def bars_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ohlcv(_by_nation(spark, sf_dir).withColumnRenamed("r_name", "instrument"), "instrument", "ts")


def bars_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ohlcv(_by_nation(spark, sf_dir).withColumnRenamed("n_name", "instrument"), "instrument", "ts")


def _by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    return trades(spark, sf_dir).join(supplier, "l_suppkey").join(nation, "n_nationkey").join(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), "r_regionkey")


def bars_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("instrument"))
    return ohlcv(trades(spark, sf_dir).join(part, "l_partkey"), "instrument", "ts")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as ticks: instrument is the event type; a tick's size is 1 and its money the value."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("instrument"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.col("event_id").alias("tick"),
        F.lit(1.0).alias("size"), F.col("value").alias("money"),
    )


def bucket(ts: Column | str, step: str) -> Column:
    """The start of the window of a length ("1 hour") that a moment falls into."""
    return F.window(ts, step).getField("start")


def bars_event(spark: SparkSession, sf_dir: str, step: str = "1 hour") -> DataFrame:
    """Bars stamped at their window's end. Ticks of one moment are ordered by their id."""
    t = ticks(spark, sf_dir).withColumn("order", F.unix_micros("ts") * 1000 + F.col("tick") % 1000)
    return ohlcv(t.withColumn("end", F.window("ts", step).getField("end")), "instrument", "end", order="order").withColumnRenamed("end", "ts")


def settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funding-like cash: (instrument, settle, rate), one per nation and order day."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("instrument"))
    day = F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).alias("settle")
    rate = F.round((F.avg("o_totalprice") - 150000) / 1e8, 12).alias("rate")
    return orders.join(customer, "o_custkey").join(nation, "n_nationkey").groupBy("instrument", day).agg(rate)


def dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instrument, ex_day, amount): a cash amount on the first settlement day of each month."""
    first = settlements(spark, sf_dir).groupBy("instrument", F.trunc("settle", "MM").alias("m")).agg(F.min("settle").alias("ex_day"), F.round(F.abs(F.min_by("rate", "settle")) * 1000, 6).alias("amount"))
    return first.drop("m")


# The same views as DuckDB common table expressions.
SQL_TRADES = """trades AS (
  SELECT l_partkey, l_suppkey, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, l_extendedprice / l_quantity AS price, l_quantity AS size,
    l_extendedprice AS money, (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey % 1000000 AS tick FROM lineitem WHERE l_quantity > 0)"""
_AGG = "arg_min(price, tick) AS open, max(price) AS high, min(price) AS low, arg_max(price, tick) AS close, sum(size) AS volume, round(sum(money), 4) AS dollar_volume"
_NATIONS = "trades JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey"
SQL_REGION = f"{SQL_TRADES}, bars AS (SELECT r_name AS instrument, ts, {_AGG} FROM {_NATIONS} GROUP BY 1, 2)"
SQL_NATION = f"{SQL_TRADES}, bars AS (SELECT n_name AS instrument, ts, {_AGG} FROM {_NATIONS} GROUP BY 1, 2)"
SQL_BRAND = f"{SQL_TRADES}, bars AS (SELECT p_brand AS instrument, ts, {_AGG} FROM trades JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"
SQL_TICKS = "ticks AS (SELECT event_type AS instrument, ts, value AS price, event_id AS tick, 1.0::DOUBLE AS size, value AS money FROM events)"


def sql_event(step: str = "1 hour") -> str:
    moment = "epoch_us(ts) * 1000 + tick % 1000"
    agg = _AGG.replace("arg_min(price, tick)", f"arg_min(price, {moment})").replace("arg_max(price, tick)", f"arg_max(price, {moment})")
    cut = f"time_bucket(INTERVAL '{step}', ts, TIMESTAMP '1970-01-01') + INTERVAL '{step}'"
    return f"{SQL_TICKS}, bars AS (SELECT instrument, {cut} AS ts, {agg} FROM ticks GROUP BY 1, 2)"


SQL_SETTLEMENTS = """settlements AS (
  SELECT n_name AS instrument, date_trunc('day', o_orderdate)::TIMESTAMP AS settle, round((avg(o_totalprice) - 150000) / 1e8, 12) AS rate
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)"""
SQL_DIVIDENDS = f"""{SQL_SETTLEMENTS}, dividends AS (
  SELECT instrument, min(settle) AS ex_day, round(abs(arg_min(rate, settle)) * 1000, 6) AS amount FROM settlements
  GROUP BY instrument, date_trunc('month', settle))"""
