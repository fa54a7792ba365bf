"""Queries on bars: building, cleaning, aligning, resampling and joining."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.operators import panel as P
from ravelin.plans.registry import query
from ravelin.sources import views as V

BAR = "instrument, ts, open, high, low, close, volume, dollar_volume"
W = "OVER (PARTITION BY instrument ORDER BY ts)"
GRID = "grid AS (SELECT i.instrument, t.ts FROM (SELECT DISTINCT ts FROM bars) t, (SELECT DISTINCT instrument FROM bars) i)"
PANEL = f"{GRID}, panel AS (SELECT * FROM grid LEFT JOIN bars USING (instrument, ts))"


@query("bars_daily_ohlcv", f"WITH {V.SQL_REGION} SELECT {BAR} FROM bars")
def bars_daily(spark: SparkSession, sf: str) -> DataFrame:
    return V.bars_region(spark, sf)


@query("bars_nation_daily", f"WITH {V.SQL_NATION} SELECT {BAR} FROM bars")
def bars_nation(spark: SparkSession, sf: str) -> DataFrame:
    return V.bars_nation(spark, sf)


@query("bars_brand_daily", f"WITH {V.SQL_BRAND} SELECT {BAR} FROM bars")
def bars_brand(spark: SparkSession, sf: str) -> DataFrame:
    return V.bars_brand(spark, sf)


@query("bars_hourly_events", f"WITH {V.sql_event('1 hour')} SELECT {BAR} FROM bars")
def bars_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return V.bars_event(spark, sf)


@query("bars_minute_events", f"WITH {V.sql_event('1 minute')} SELECT {BAR} FROM bars")
def bars_minute(spark: SparkSession, sf: str) -> DataFrame:
    return V.bars_event(spark, sf, "1 minute")


_LONGER = """SELECT instrument, {stamp} AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close,
  sum(volume) AS volume, round(sum(dollar_volume), 4) AS dollar_volume, count(*) AS n_bars FROM bars GROUP BY instrument, {key} {having}"""


@query("bars_4h_events", f"WITH {V.sql_event()} " + _LONGER.format(stamp="max(ts)", key="floor((epoch_us(ts) - 1) / 14400000000)", having=""))
def bars_4h(spark: SparkSession, sf: str) -> DataFrame:
    return P.resampled(V.bars_event(spark, sf), F.floor((F.unix_micros("ts") - 1) / 14_400_000_000))


@query("bars_weekly", f"WITH {V.SQL_REGION} " + _LONGER.format(stamp="max(ts)", key="date_trunc('week', ts)", having=""))
def bars_weekly(spark: SparkSession, sf: str) -> DataFrame:
    return P.resampled(V.bars_region(spark, sf), F.date_trunc("week", "ts"))


@query("bars_monthly", f"WITH {V.SQL_REGION} " + _LONGER.format(stamp="max(ts)", key="date_trunc('month', ts)", having=""))
def bars_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return P.resampled(V.bars_region(spark, sf), F.trunc("ts", "MM"))


_NY = "(ts - INTERVAL 1 HOUR) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York'"


@query("bars_session_offset_17h", f"WITH {V.sql_event()} " + _LONGER.format(stamp="max(ts)", key=f"({_NY} + INTERVAL 7 HOUR)::DATE", having="HAVING count(*) >= 20"))
def bars_session(spark: SparkSession, sf: str) -> DataFrame:
    start = F.col("ts") - F.expr("INTERVAL 1 HOUR")
    return P.resampled(V.bars_event(spark, sf), P.session_day(start, "America/New_York", 17), least=20)


_BLOCK = f"floor(((hour({_NY}) + 7) % 24) / 4)"


@query("bars_fx_4h_blocks", f"WITH {V.sql_event()} " + _LONGER.format(stamp="max(ts)", key=f"({_NY} + INTERVAL 7 HOUR)::DATE, {_BLOCK}", having="HAVING count(*) >= 4"))
def bars_fx_4h(spark: SparkSession, sf: str) -> DataFrame:
    start = F.col("ts") - F.expr("INTERVAL 1 HOUR")
    block = F.floor(((F.hour(F.from_utc_timestamp(start, "America/New_York")) + 7) % 24) / 4)
    return P.resampled(V.bars_event(spark, sf), F.struct(P.session_day(start, "America/New_York", 17), block), least=4)


@query("fx_session_bars", f"""WITH {V.sql_event()}, m AS (SELECT instrument, ts, close, {_NY} AS t FROM bars),
  x AS (SELECT *, dayofweek(t) * 1440 + hour(t) * 60 + minute(t) AS m FROM m)
  SELECT instrument, ts, close, (m >= 1020 AND m < 8220) AS in_session FROM x""")
def fx_session(spark: SparkSession, sf: str) -> DataFrame:
    return V.bars_event(spark, sf).select("instrument", "ts", "close", P.in_fx_session(F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("in_session"))


_RAW = """raw AS (SELECT l_returnflag AS instrument, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, l_extendedprice AS open, l_extendedprice * (1 + l_tax) AS high,
  l_extendedprice * (1 - l_discount) AS low, l_extendedprice * (CASE WHEN l_linenumber = 7 THEN 1.2 ELSE 1 END) AS close, l_orderkey * 100 + l_linenumber AS tick FROM lineitem)"""
_REASON = """CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL THEN 'null_price' WHEN least(open, high, low, close) <= 0 THEN 'not_positive'
  WHEN high < greatest(open, close) OR low > least(open, close) THEN 'high_low' END"""
_CLEAN = f"""WITH {_RAW}, r AS (SELECT *, {_REASON} AS r FROM raw), c AS (
  SELECT *, CASE WHEN r IS NULL AND row_number() OVER (PARTITION BY instrument, ts, r IS NULL ORDER BY tick DESC) > 1 THEN 'duplicate' ELSE r END AS reason FROM r)"""


def raw_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Uncleaned bars: one per line, with clashing moments and some whose close lies outside of the range."""
    price = F.col("l_extendedprice")
    return V.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("instrument"), F.date_trunc("day", F.col("l_shipdate").cast("timestamp")).alias("ts"), price.alias("open"), (price * (1 + F.col("l_tax"))).alias("high"),
        (price * (1 - F.col("l_discount"))).alias("low"), (price * F.when(F.col("l_linenumber") == 7, 1.2).otherwise(1.0)).alias("close"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("tick"),
    )


@query("bars_clean_reasons", f"{_CLEAN} SELECT instrument, coalesce(reason, 'kept') AS reason, count(*) AS n FROM c GROUP BY 1, 2")
def clean_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return P.clean(raw_bars(spark, sf), "tick").groupBy("instrument", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("bars_duplicates_keep_last", f"{_CLEAN} SELECT instrument, ts, open, close, tick FROM c WHERE reason IS NULL")
def keep_last(spark: SparkSession, sf: str) -> DataFrame:
    return P.clean(raw_bars(spark, sf), "tick").where("reason IS NULL").select("instrument", "ts", "open", "close", "tick")


@query("panel_grid_aligned", f"WITH {V.SQL_REGION}, {PANEL} SELECT {BAR} FROM panel")
def grid_aligned(spark: SparkSession, sf: str) -> DataFrame:
    return P.aligned(V.bars_region(spark, sf))


@query("panel_as_known", f"""WITH {V.SQL_REGION}, {PANEL}, k AS (SELECT *, last_value(close IGNORE NULLS) {W} AS lc FROM panel)
  SELECT instrument, ts, coalesce(open, lc) AS open, coalesce(high, lc) AS high, coalesce(low, lc) AS low, coalesce(close, lc) AS close,
    coalesce(volume, CASE WHEN lc IS NOT NULL THEN 0 END) AS volume, coalesce(dollar_volume, CASE WHEN lc IS NOT NULL THEN 0 END) AS dollar_volume FROM k""")
def as_known(spark: SparkSession, sf: str) -> DataFrame:
    return P.known(P.aligned(V.bars_region(spark, sf)))


@query("panel_started", f"WITH {V.SQL_NATION}, {PANEL} SELECT instrument, ts, count(close) {W} > 0 AS started FROM panel")
def panel_started(spark: SparkSession, sf: str) -> DataFrame:
    return P.started(P.aligned(V.bars_nation(spark, sf))).select("instrument", "ts", "started")


@query("panel_ended", f"""WITH {V.SQL_NATION}, {PANEL}, e AS (SELECT *, max(CASE WHEN close IS NOT NULL THEN ts END) OVER (PARTITION BY instrument) AS lb, (SELECT max(ts) FROM panel) AS pe FROM panel)
  SELECT instrument, ts, (lb < pe - INTERVAL 2 DAY AND ts > lb) AS ended FROM e""")
def panel_ended(spark: SparkSession, sf: str) -> DataFrame:
    return P.ended(P.aligned(V.bars_nation(spark, sf)), 2).select("instrument", "ts", "ended")


@query("tradable_bars", f"""WITH {V.SQL_REGION}, {PANEL}, t AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
    max(volume) OVER (PARTITION BY instrument) > 0 AS ever FROM panel)
  SELECT instrument, ts, open IS NOT NULL AND NOT coalesce(ever AND volume = 0 AND open = close AND high = low AND close = b, false) AS tradable FROM t""")
def tradable(spark: SparkSession, sf: str) -> DataFrame:
    return P.tradable(P.aligned(V.bars_region(spark, sf))).select("instrument", "ts", "tradable")


_HOLES = f"""holes AS (SELECT instrument, count(close) {W} AS island, count(close) OVER (PARTITION BY instrument) AS total, ts, close FROM panel),
  runs AS (SELECT instrument, min(ts) AS first, max(ts) AS last, count(*) AS bars FROM holes WHERE close IS NULL AND island > 0 AND island < total GROUP BY instrument, island)"""


@query("missing_runs", f"WITH {V.SQL_NATION}, {PANEL}, {_HOLES} SELECT * FROM runs")
def missing_runs(spark: SparkSession, sf: str) -> DataFrame:
    return P.missing_runs(P.aligned(V.bars_nation(spark, sf)))


@query("shared_holes", f"WITH {V.SQL_NATION}, {PANEL}, {_HOLES} SELECT first, last, count(*) AS names FROM runs GROUP BY 1, 2 HAVING count(*) >= greatest(3, (SELECT count(DISTINCT instrument) FROM bars) / 10)")
def shared_holes(spark: SparkSession, sf: str) -> DataFrame:
    bars = V.bars_nation(spark, sf)
    n = F.broadcast(bars.agg((F.count_distinct("instrument") / 10).alias("many")))  # one row
    runs = P.missing_runs(P.aligned(bars)).groupBy("first", "last").agg(F.count(F.lit(1)).alias("names"))
    return runs.join(n).where(F.col("names") >= F.greatest(F.lit(3.0), "many")).drop("many")


@query("dead_runs", f"""WITH {V.sql_event('1 minute')}, f AS (SELECT *, (open = close AND high = low AND high = open) AS flat FROM bars),
  c AS (SELECT *, CASE WHEN flat IS DISTINCT FROM lag(flat) {W} THEN 1 ELSE 0 END AS ch FROM f), i AS (SELECT *, sum(ch) {W} AS island FROM c)
  SELECT instrument, min(ts) AS first, max(ts) AS last, count(*) AS bars FROM i WHERE flat GROUP BY instrument, island HAVING count(*) >= 3""")
def dead_runs(spark: SparkSession, sf: str) -> DataFrame:
    flat = (F.col("open") == F.col("close")) & (F.col("high") == F.col("low")) & (F.col("high") == F.col("open"))
    islands = P.runs_of(V.bars_event(spark, sf, "1 minute").withColumn("flat", flat), "flat").where("flat")
    return islands.groupBy("instrument", "island").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("bars")).where("bars >= 3").drop("island")


@query("repeats_close_rows", f"""WITH {V.sql_event('1 minute')}, r AS (SELECT *, lag(close) {W} AS b FROM bars)
  SELECT instrument, ts, close FROM r WHERE open = b AND high = b AND low = b AND close = b""")
def repeats_close(spark: SparkSession, sf: str) -> DataFrame:
    b = V.bars_event(spark, sf, "1 minute").withColumn("b", F.lag("close").over(P.own()))
    return b.where("open = b AND high = b AND low = b AND close = b").select("instrument", "ts", "close")


@query("series_profile", f"""WITH {V.SQL_NATION}, g AS (SELECT *, date_diff('day', lag(ts) {W}, ts) AS gap FROM bars)
  SELECT instrument, min(ts) AS first, max(ts) AS last, count(*) AS bars, sum(CASE WHEN gap > 1 THEN 1 ELSE 0 END)::BIGINT AS holes, max(gap)::INTEGER AS longest,
    sum(CASE WHEN volume = 0 THEN 1 ELSE 0 END)::BIGINT AS idle FROM g GROUP BY instrument""")
def series_profile(spark: SparkSession, sf: str) -> DataFrame:
    g = V.bars_nation(spark, sf).withColumn("gap", F.datediff("ts", F.lag("ts").over(P.own())))
    return g.groupBy("instrument").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("bars"), F.count_if(F.col("gap") > 1).alias("holes"), F.max("gap").alias("longest"), F.count_if(F.col("volume") == 0).alias("idle"))


@query("stale_tail_days", f"WITH {V.SQL_NATION} SELECT instrument, date_diff('day', max(ts), (SELECT max(ts) FROM bars))::INTEGER AS days FROM bars GROUP BY 1")
def stale_tail(spark: SparkSession, sf: str) -> DataFrame:
    bars = V.bars_nation(spark, sf)
    end = F.broadcast(bars.agg(F.max("ts").alias("end")))  # one row
    return bars.groupBy("instrument").agg(F.max("ts").alias("last")).join(end).select("instrument", F.datediff("end", "last").alias("days"))


@query("continuity_cut", f"""WITH {V.SQL_NATION}, g AS (SELECT *, CASE WHEN date_diff('day', lag(ts) {W}, ts) > 5 THEN ts END AS cut FROM bars),
  c AS (SELECT *, max(cut) OVER (PARTITION BY instrument) AS from_ FROM g) SELECT instrument, ts, close FROM c WHERE from_ IS NULL OR ts >= from_""")
def continuity_cut(spark: SparkSession, sf: str) -> DataFrame:
    g = V.bars_nation(spark, sf).withColumn("cut", F.when(F.datediff("ts", F.lag("ts").over(P.own())) > 5, F.col("ts")))
    return g.withColumn("since", F.max("cut").over(Window.partitionBy("instrument"))).where("since IS NULL OR ts >= since").select("instrument", "ts", "close")


@query("joined_markets", f"""WITH {V.SQL_NATION}, r AS (SELECT instrument, ts, open / lag(close) {W} AS ratio FROM bars)
  SELECT instrument, ts, round(ratio, 6) AS ratio FROM r WHERE ratio > 1.8 OR ratio < 0.55""")
def joined_markets(spark: SparkSession, sf: str) -> DataFrame:
    r = V.bars_nation(spark, sf).withColumn("ratio", F.col("open") / F.lag("close").over(P.own()))
    return r.where("ratio > 1.8 OR ratio < 0.55").select("instrument", "ts", F.round("ratio", 6).alias("ratio"))


_CUT = "TIMESTAMP '2000-01-01'"


@query("upsert_append_newer", f"""WITH {V.SQL_REGION}, stored AS (SELECT * FROM bars WHERE ts < {_CUT}), l AS (SELECT instrument, max(ts) AS last FROM stored GROUP BY 1)
  SELECT {BAR} FROM stored UNION ALL SELECT {BAR} FROM (SELECT * FROM bars WHERE ts >= TIMESTAMP '1999-06-01') n LEFT JOIN l USING (instrument) WHERE last IS NULL OR ts > last""")
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    bars = V.bars_region(spark, sf)
    return P.upsert(bars.where(F.col("ts") < F.lit("2000-01-01").cast("timestamp")), bars.where(F.col("ts") >= F.lit("1999-06-01").cast("timestamp")))


@query("source_priority_union", f"""WITH {V.SQL_REGION}, s AS (SELECT {BAR}, 0 AS source FROM bars WHERE day(ts) % 3 <> 0 UNION ALL SELECT {BAR}, 1 AS source FROM bars),
  n AS (SELECT *, row_number() OVER (PARTITION BY instrument, ts ORDER BY source) AS n FROM s) SELECT {BAR}, source FROM n WHERE n = 1""")
def priority_union(spark: SparkSession, sf: str) -> DataFrame:
    bars = V.bars_region(spark, sf)
    return P.by_priority(bars.where(F.dayofmonth("ts") % 3 != 0), bars)


for _every, _key in {"month": "date_trunc('month', ts)", "week": "date_trunc('week', ts)", "5day": "floor(date_diff('day', DATE '1970-01-01', ts::DATE) / 5)"}.items():

    def _period(spark: SparkSession, sf: str, every: str = {"month": "M", "week": "W", "5day": "5D"}[_every]) -> DataFrame:
        return V.bars_region(spark, sf).select("instrument", "ts", P.period_start(F.col("ts"), every).alias("start"))

    query(f"period_starts_{_every}", f"WITH {V.SQL_REGION} SELECT instrument, ts, {_key} IS DISTINCT FROM lag({_key}) {W} AS start FROM bars")(_period)


@query("series_symbols", f"WITH {V.SQL_BRAND} SELECT DISTINCT instrument FROM bars")
def symbols(spark: SparkSession, sf: str) -> DataFrame:
    return V.bars_brand(spark, sf).select("instrument").distinct()


@query("quarantined_series", f"""WITH {V.SQL_NATION}, bad AS (SELECT instrument FROM bars GROUP BY 1 HAVING count(*) < 0.97 * (SELECT max(n) FROM (SELECT count(*) AS n FROM bars GROUP BY instrument)))
  SELECT instrument, ts, close FROM bars WHERE instrument NOT IN (SELECT instrument FROM bad)""")
def quarantined(spark: SparkSession, sf: str) -> DataFrame:
    bars = V.bars_nation(spark, sf)
    n = bars.groupBy("instrument").agg(F.count(F.lit(1)).alias("n"))
    bad = n.join(F.broadcast(n.agg(F.max("n").alias("most")))).where("n < 0.97D * most")  # one row
    return bars.join(bad.select("instrument"), "instrument", "left_anti").select("instrument", "ts", "close")


@query("series_hash", f"""WITH {V.SQL_REGION} SELECT instrument, min(ts) AS first, count(*) AS n,
  sha256(string_agg(volume::BIGINT::VARCHAR, ',' ORDER BY ts)) AS sha FROM bars GROUP BY instrument""")
def series_hash(spark: SparkSession, sf: str) -> DataFrame:
    bars = V.bars_region(spark, sf).groupBy("instrument").agg(F.min("ts").alias("first"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("ts", F.col("volume").cast("long").cast("string").alias("v")))).alias("x"))
    return bars.select("instrument", "first", "n", F.sha2(F.concat_ws(",", F.col("x.v")), 256).alias("sha"))


@query("short_history", f"""WITH {V.SQL_NATION}, e AS (SELECT instrument, min(ts) AS daily, min(CASE WHEN volume >= 100 THEN ts END) AS fine FROM bars GROUP BY 1)
  SELECT instrument, daily, fine, date_diff('day', daily, fine)::INTEGER AS days FROM e WHERE fine > daily + INTERVAL 3 DAY""")
def short_history(spark: SparkSession, sf: str) -> DataFrame:
    e = V.bars_nation(spark, sf).groupBy("instrument").agg(F.min("ts").alias("daily"), F.min(F.when(F.col("volume") >= 100, F.col("ts"))).alias("fine"))
    return e.where("fine > daily + INTERVAL 3 DAYS").select("instrument", "daily", "fine", F.datediff("fine", "daily").alias("days"))


@query("near_constant_names", f"""WITH {V.sql_event()}, m AS (SELECT instrument, median(close) AS m FROM bars GROUP BY 1)
  SELECT instrument, round(avg(CASE WHEN abs(close / m - 1) <= 0.5 THEN 1 ELSE 0 END), 6) AS share FROM bars JOIN m USING (instrument) GROUP BY 1""")
def near_constant(spark: SparkSession, sf: str) -> DataFrame:
    bars = V.bars_event(spark, sf)
    m = bars.groupBy("instrument").agg(F.expr("percentile(close, 0.5D)").alias("m"))
    return bars.join(m, "instrument").groupBy("instrument").agg(F.round(F.avg((F.abs(F.col("close") / F.col("m") - 1) <= 0.5).cast("int")), 6).alias("share"))
