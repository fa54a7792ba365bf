"""Queries that drain a stream over events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions import indicators as I
from ravelin.plans.registry import query
from ravelin.sources.store import read_bars, shared_dir
from ravelin.sources import views as V
from ravelin.streaming import bars as S
from ravelin.streaming import refresh as R
from ravelin.streaming import upkeep as U


@query("stream_bars", f"WITH {V.sql_event('1 hour')} SELECT instrument, ts, open, high, low, close, volume FROM bars")
def stream_bars(spark: SparkSession, sf: str) -> DataFrame:
    return S.whole(spark, sf, S.hourly_bars)


@query("stream_sliding_volume", """WITH w AS (SELECT event_type AS instrument, value, time_bucket(INTERVAL 6 HOURS, ts) - INTERVAL 6 HOURS * k AS start FROM events, (SELECT unnest(range(0, 4)) AS k))
  SELECT instrument, start, start + INTERVAL 24 HOURS AS "end", count(*) AS n, median(value) AS median FROM w GROUP BY instrument, start""")
def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return S.whole(spark, sf, S.sliding_volume)


@query("stream_sessions", """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS "end", count(*) AS n, round(sum(value), 6) AS value FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return S.whole(spark, sf, S.sessions).withColumn("value", F.round("value", 6))


@query("stream_positions", """WITH e AS (SELECT event_type AS instrument, ts, event_id, last_value(CASE WHEN value < 20 THEN 1.0 WHEN value > 80 THEN 0.0 END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events),
  c AS (SELECT *, coalesce(p, 0) AS position, coalesce(lag(p) OVER (PARTITION BY instrument ORDER BY ts, event_id), 0) AS b FROM e) SELECT instrument, ts, event_id, position::DOUBLE AS position FROM c WHERE position <> b""")
def stream_positions(spark: SparkSession, sf: str) -> DataFrame:
    return S.drained(S.positions(S.events(spark, sf)))


@query("stream_change_feed", "SELECT event_type AS kind, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def stream_changes(spark: SparkSession, sf: str) -> DataFrame:
    return S.change_feed(spark, sf).groupBy("kind").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


@query("stream_restated", f"""WITH {V.SQL_REGION}, a AS (SELECT 1 AS batch, instrument, ts, close FROM bars WHERE ts < TIMESTAMP '1995-01-01' UNION ALL SELECT 2, instrument, ts, CASE WHEN instrument IN ('ASIA', 'EUROPE') THEN close * 2 ELSE close END FROM bars WHERE CASE WHEN instrument IN ('ASIA', 'EUROPE') THEN ts < TIMESTAMP '1997-01-01' ELSE ts >= TIMESTAMP '1994-12-01' AND ts < TIMESTAMP '1997-01-01' END)
  SELECT instrument, count(DISTINCT ts) AS bars, round(sum(close), 4) AS total FROM (SELECT * FROM a WHERE batch = 2 UNION ALL SELECT * FROM a WHERE batch = 1 AND instrument NOT IN ('ASIA', 'EUROPE') AND ts < TIMESTAMP '1994-12-01') GROUP BY 1""")
def stream_restated(spark: SparkSession, sf: str) -> DataFrame:
    """Two arrivals that overlap: two series come again at another level and replace what was stored, the others go on."""
    b = V.bars_region(spark, sf).select("instrument", "ts", "close")
    again, at = F.col("instrument").isin("ASIA", "EUROPE"), lambda d: F.lit(d).cast("timestamp")
    one = b.where(F.col("ts") < at("1995-01-01")).withColumn("batch", F.lit(1))
    two = b.where((F.col("ts") < at("1997-01-01")) & (again | (F.col("ts") >= at("1994-12-01")))).withColumn("close", F.when(again, F.col("close") * 2).otherwise(F.col("close"))).withColumn("batch", F.lit(2))
    out = U.restated(spark, one.unionByName(two))
    return out.groupBy("instrument").agg(F.count_distinct("ts").alias("bars"), F.round(F.sum("close"), 4).alias("total"))


@query("stream_silent_runs", """WITH e AS (SELECT user_id::VARCHAR || '-' || strftime(ts, '%Y%m%d%H') AS run, ts FROM events), g AS (SELECT run, ts, lead(ts) OVER (PARTITION BY run ORDER BY ts) AS nx FROM e)
  SELECT run, ts AS last_beat, nx IS NULL AS interrupted FROM g WHERE nx IS NULL OR epoch_us(nx) - epoch_us(ts) > 120000000""")
def stream_silent(spark: SparkSession, sf: str) -> DataFrame:
    """Runs without a sign for two minutes, those silent at the end of the input too."""
    run = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMddHH"))  # the mark of the end has a run of its own; a filter would take it from the watermark
    return S.whole(spark, sf, lambda e: U.silent(e.select(run.alias("run"), "ts")))


@query("change_log_kept", "SELECT event_type AS kind, count(*) AS n, min(event_id) AS first_id FROM events WHERE epoch(ts)::BIGINT > (SELECT max(epoch(ts)::BIGINT) FROM events) - 86400 GROUP BY 1")
def change_log(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of the last day, by kind."""
    e = V.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return U.recent_changes(e).groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


FIRST_RUN = "2024-01-17 12:30:00"  # events up to here arrive before the first run of the refresh


@query("store_refresh", f"WITH {V.sql_event('1 hour')} SELECT instrument, ts, open, high, low, close, volume FROM bars WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 2 HOURS")
def store_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """A store of hourly bars after two runs of its refresh: the hour that the first run left open is closed by the second."""
    root = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    events = V.table(spark, sf, "events")
    for late in (False, True):
        events.where((F.col("ts") >= F.lit(FIRST_RUN).cast("timestamp_ntz")) == late).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(S.EVENTS).parquet(f"{root}/in").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", R.LATE)
        R.refresh(S.hourly_bars(stream), f"{root}/store", "1h")
    return read_bars(spark, f"{root}/store", "1h", columns=["open", "high", "low", "close", "volume"])


def _plan_sql() -> str:
    avg = lambda n: f"CASE WHEN count(close) OVER (PARTITION BY instrument ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN avg(close) OVER (PARTITION BY instrument ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"
    return f"""WITH {V.SQL_REGION}, t AS (SELECT instrument, ts, coalesce(sign({avg(10)} - {avg(100)}), 0)::INT AS side FROM bars), p AS (SELECT max(ts) AS ts FROM bars GROUP BY year(ts)),
  o AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS before FROM p), m AS (SELECT t.instrument, t.ts, t.side AS to_side, coalesce(b.side, 0) AS from_side FROM t JOIN o USING (ts) LEFT JOIN t b ON b.instrument = t.instrument AND b.ts = o.before)
  SELECT instrument, ts, from_side, to_side, nth::INT AS nth, CASE WHEN to_side > from_side THEN 'BUY' ELSE 'SELL' END AS action FROM m, (SELECT unnest([0, 1]) AS nth) WHERE nth < abs(to_side - from_side)"""


@query("forward_plans", _plan_sql())
def forward_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a plan per year's last bar, each against the sides that the plan before saved; every second plan is run twice."""
    from ravelin.sources.store import kept

    root = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    side = I.cross(I.sma("close", 10), I.sma("close", 100))
    t = kept(V.bars_region(spark, sf).select("instrument", "ts", F.coalesce(side, F.lit(0.0)).alias("weight")), "targets")
    ends = t.groupBy(F.year("ts").alias("year")).agg(F.max("ts").alias("ts"))
    for i, row in enumerate(sorted(ends.collect(), key=lambda r: r.ts)):  # a year's last bar each
        for _ in range(1 + i % 2):
            R.plan(t, root, row.ts)
    return R.read_orders(spark, root).drop("weight")
