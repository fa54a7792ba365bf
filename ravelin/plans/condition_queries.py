"""Queries on conditioning, universes and the read model of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.operators import conditioning as C
from ravelin.operators import metrics as M
from ravelin.operators.panel import own
from ravelin.plans.record_queries import SQL_CORE, SQL_RECORD, record, rounded
from ravelin.plans.registry import query
from ravelin.plans.signal_queries import r6
from ravelin.sources import store
from ravelin.sources import views as V

W = "OVER (PARTITION BY instrument ORDER BY ts)"
HOURS = f"WITH {V.sql_event().replace('bars AS', 'hours0 AS')}, hours AS (SELECT *, date_trunc('day', ts - INTERVAL 1 MICROSECOND) AS day FROM hours0), days AS (SELECT instrument, day, arg_min(open, ts) * 1.01 AS open, max(high) * 0.98 AS high, min(low) * 1.02 AS low, arg_max(close, ts) * 0.99 AS close, sum(volume) * 2 AS volume FROM hours GROUP BY 1, 2)"


def hours_days(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    h = V.bars_event(spark, sf).withColumn("day", F.date_trunc("day", F.col("ts") - F.expr("INTERVAL 1 MICROSECOND")))
    d = h.groupBy("instrument", "day").agg(
        (F.min_by("open", "ts") * 1.01).alias("open"), (F.max("high") * 0.98).alias("high"), (F.min("low") * 1.02).alias("low"), (F.max_by("close", "ts") * 0.99).alias("close"), (F.sum("volume") * 2).alias("volume")
    )
    return h, d


@query("conform_hourly_to_daily", f"""{HOURS}, j AS (SELECT h.*, d.open AS dor, d.high AS dh, d.low AS dl, d.close AS dc, d.volume AS dv, min(ts) OVER w AS f, max(ts) OVER w AS l, sum(h.volume) OVER w AS sv FROM hours h JOIN days d USING (instrument, day) WINDOW w AS (PARTITION BY instrument, day)),
  o AS (SELECT *, CASE WHEN ts = f THEN dor ELSE least(greatest(open, dl), dh) END AS o, CASE WHEN ts = l THEN dc ELSE least(greatest(close, dl), dh) END AS c FROM j)
  SELECT instrument, ts, round(o, 6) AS open, round(greatest(least(greatest(high, dl), dh), o, c), 6) AS high, round(least(least(greatest(low, dl), dh), o, c), 6) AS low, round(c, 6) AS close, round(volume * dv / nullif(sv, 0), 6) AS volume FROM o""")
def conform_hourly(spark: SparkSession, sf: str) -> DataFrame:
    h, d = hours_days(spark, sf)
    return rounded(C.fitted_to_days(h, d).drop("day"))


@query("hourly_on_daily_basis", f"""{HOURS}, l AS (SELECT instrument, day, arg_max(close, ts) AS h FROM hours GROUP BY 1, 2), r AS (SELECT instrument, day, d.close / h AS r FROM l JOIN days d USING (instrument, day)),
  m AS (SELECT *, median(r) OVER (PARTITION BY instrument ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS ratio FROM r) SELECT instrument, ts, round(close * ratio, 6) AS close FROM hours JOIN m USING (instrument, day)""")
def on_basis(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.on_basis(*hours_days(spark, sf)).select("instrument", "ts", "close"))


@query("repair_stale_runs")
def repair_stale(spark: SparkSession, sf: str) -> DataFrame:
    """A tenth of each month is made stale and put right from another source at another level."""
    b = V.bars_region(spark, sf).select("instrument", "ts", "open", "high", "low", "close")
    base = F.last(F.when(F.dayofmonth("ts") > 4, F.col("close")), ignorenulls=True).over(own())
    stale = b.withColumn("_b", base).withColumns({c: F.when((F.dayofmonth("ts") <= 4) & F.col("_b").isNotNull(), F.col("_b")).otherwise(F.col(c)) for c in ("open", "high", "low", "close")}).drop("_b")
    other = b.withColumns({c: F.col(c) * 0.5 for c in ("open", "high", "low", "close")})
    return rounded(C.stale_replaced(stale, other))


_CONTRACTS = "c AS (SELECT instrument, ts, date_trunc('month', ts) AS contract, close, close * (1 + 0.01 * (month(ts) % 3)) AS next_close FROM bars)"


@query("back_adjust_rolls", f"WITH {V.SQL_REGION}, {_CONTRACTS}, r AS (SELECT *, CASE WHEN lead(contract) {W} <> contract AND next_close > 0 THEN ln(next_close / close) ELSE 0 END AS r FROM c) SELECT instrument, ts, round(close * exp(sum(r) OVER (PARTITION BY instrument ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS adjusted FROM r")
def back_adjust(spark: SparkSession, sf: str) -> DataFrame:
    c = V.bars_region(spark, sf).select("instrument", "ts", F.date_trunc("month", "ts").alias("contract"), "close", (F.col("close") * (1 + 0.01 * (F.month("ts") % 3))).alias("next_close"))
    return rounded(C.back_adjusted(c).select("instrument", "ts", "adjusted"))


@query("splice_series", f"""WITH {V.SQL_REGION}, n AS (SELECT instrument, ts, close FROM bars WHERE ts >= TIMESTAMP '1998-01-01'), o AS (SELECT instrument, ts, close * 0.9 AS close FROM bars WHERE ts < TIMESTAMP '1998-06-01'),
  s AS (SELECT instrument, min(ts) AS seam, arg_min(n.close / o.close, ts) AS k FROM n JOIN o USING (instrument, ts) GROUP BY 1)
  SELECT instrument, ts, round(close * k, 6) AS close, 'old' AS source FROM o JOIN s USING (instrument) WHERE ts < seam UNION ALL SELECT instrument, ts, round(close, 6), 'new' FROM n LEFT JOIN s USING (instrument) WHERE seam IS NULL OR ts >= seam""")
def splice(spark: SparkSession, sf: str) -> DataFrame:
    b = V.bars_region(spark, sf)
    day = lambda d: F.lit(d).cast("timestamp")
    return rounded(C.spliced(b.where(F.col("ts") < day("1998-06-01")).withColumn("close", F.col("close") * 0.9), b.where(F.col("ts") >= day("1998-01-01"))))


@query("agreeing_months")
def agreeing(spark: SparkSession, sf: str) -> DataFrame:
    """A series against itself a bar late: the best shift of whole months is one bar back."""
    b = V.bars_region(spark, sf)
    late = b.withColumn("close", F.lag("close").over(own())).where("close IS NOT NULL")
    lag = C.best_lag(b, late)
    return rounded(lag.where("lag = -1 AND rho > 0.999999D").select("instrument", "month", "rho"))


@query("split_factor", f"""WITH {V.SQL_REGION}, s AS (SELECT instrument, date_trunc('year', ts) + INTERVAL 180 DAY AS day, 2.0 AS ratio FROM bars WHERE year(ts) % 2 = 0 GROUP BY 1, 2)
  SELECT b.instrument, b.ts, round(exp(coalesce(sum(ln(ratio)), 0)), 6) AS factor FROM bars b LEFT JOIN s ON s.instrument = b.instrument AND s.day > b.ts GROUP BY 1, 2""")
def split_factor(spark: SparkSession, sf: str) -> DataFrame:
    b = V.bars_region(spark, sf).select("instrument", "ts")
    s = b.where(F.year("ts") % 2 == 0).select("instrument", (F.date_trunc("year", "ts") + F.expr("INTERVAL 180 DAYS")).alias("day")).distinct().withColumn("ratio", F.lit(2.0))
    return rounded(C.split_factor(b, s))


@query("cut_at_delisting", f"""WITH {V.SQL_NATION}, l AS (SELECT *, max(CASE WHEN volume > 10 THEN ts END) OVER (PARTITION BY instrument) AS last FROM bars) SELECT instrument, ts, close FROM l WHERE ts <= last""")
def cut_delisted(spark: SparkSession, sf: str) -> DataFrame:
    last = F.max(F.when(F.col("volume") > 10, F.col("ts"))).over(Window.partitionBy("instrument"))
    return V.bars_nation(spark, sf).withColumn("last", last).where("ts <= last").select("instrument", "ts", "close")


_THIN = f"WITH {V.SQL_NATION}, b AS (SELECT instrument, ts, close, CASE WHEN day(ts) > 8 THEN volume ELSE 0 END AS volume FROM bars)"


@query("delisted_between", f"""{_THIN}, t AS (SELECT instrument, ts AS first, lead(ts) {W} AS last FROM b WHERE volume > 0), g AS (SELECT * FROM t WHERE date_diff('day', first, last) > 3)
  SELECT g.instrument, g.first, g.last FROM g JOIN b ON b.instrument = g.instrument AND b.ts > g.first AND b.ts < g.last GROUP BY 1, 2, 3 HAVING count(*) >= 0.5 * (date_diff('day', g.first, g.last) - 1)""")
def delisted_between(spark: SparkSession, sf: str) -> DataFrame:
    b = V.bars_nation(spark, sf).withColumn("volume", F.when(F.dayofmonth("ts") > 8, F.col("volume")).otherwise(0.0))
    return C.delisted_stretches(b, 3)


@query("spread_merge", f"""WITH {V.sql_event().replace('bars AS', 'h AS')}, s AS (SELECT instrument, ts, high - low + 1 AS spread FROM h), a AS (SELECT * FROM s WHERE ts >= TIMESTAMP '2024-01-10'), b AS (SELECT instrument, ts, spread * 1.5 AS spread FROM s WHERE ts < TIMESTAMP '2024-01-20'),
  k AS (SELECT instrument, median(a.spread) / nullif(median(b.spread), 0) AS k FROM a JOIN b USING (instrument, ts) GROUP BY 1), f AS (SELECT instrument, min(ts) AS first FROM a GROUP BY 1)
  SELECT instrument, ts, round(spread * k, 6) AS spread FROM b JOIN f USING (instrument) JOIN k USING (instrument) WHERE ts < first UNION ALL SELECT instrument, ts, round(spread, 6) FROM a""")
def spread_merge(spark: SparkSession, sf: str) -> DataFrame:
    s = V.bars_event(spark, sf).select("instrument", "ts", (F.col("high") - F.col("low") + 1).alias("spread"))
    day = lambda d: F.lit(d).cast("timestamp")
    return rounded(C.leveled(s.where(F.col("ts") >= day("2024-01-10")), s.where(F.col("ts") < day("2024-01-20")).withColumn("spread", F.col("spread") * 1.5)))


@query("ticks_to_hours", f"WITH {V.SQL_TICKS} SELECT instrument, date_trunc('hour', ts)::TIMESTAMP AS hour, arg_min(price, (ts, tick)) AS first, arg_max(price, (ts, tick)) AS last, count(*) AS ticks FROM ticks GROUP BY 1, 2")
def ticks_to_hours(spark: SparkSession, sf: str) -> DataFrame:
    o = F.struct("ts", "tick")
    return V.ticks(spark, sf).groupBy("instrument", F.date_trunc("hour", "ts").alias("hour")).agg(F.min_by("price", o).alias("first"), F.max_by("price", o).alias("last"), F.count(F.lit(1)).alias("ticks"))


@query("venue_minutes_to_hours", """WITH v AS (SELECT event_type AS instrument, date_trunc('minute', ts) AS minute, user_id % 5 AS venue, arg_min(value, (ts, event_id)) AS open, arg_max(value, (ts, event_id)) AS close, count(*) AS size FROM events GROUP BY 1, 2, 3),
  m AS (SELECT instrument, minute, arg_max(open, (size, -venue)) AS open, arg_max(close, (size, -venue)) AS close, sum(size) AS size FROM v GROUP BY 1, 2)
  SELECT instrument, date_trunc('hour', minute)::TIMESTAMP AS hour, round(arg_min(open, minute), 6) AS open, round(arg_max(close, minute), 6) AS close, sum(size)::BIGINT AS size FROM m GROUP BY 1, 2""")
def venue_minutes(spark: SparkSession, sf: str) -> DataFrame:
    e = V.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    o = F.struct("ts", "event_id")
    v = e.groupBy(F.col("event_type").alias("instrument"), F.date_trunc("minute", "ts").alias("minute"), (F.col("user_id") % 5).alias("venue")).agg(F.min_by("value", o).alias("open"), F.max_by("value", o).alias("close"), F.count(F.lit(1)).alias("size"))
    most = F.struct("size", -F.col("venue"))
    m = v.groupBy("instrument", "minute").agg(F.max_by("open", most).alias("open"), F.max_by("close", most).alias("close"), F.sum("size").alias("size"))
    return m.groupBy("instrument", F.date_trunc("hour", "minute").alias("hour")).agg(r6(F.min_by("open", "minute")).alias("open"), r6(F.max_by("close", "minute")).alias("close"), F.sum("size").alias("size"))


# Universes.


@query("largest_names", "WITH k AS (SELECT p_partkey, p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) SELECT p_brand AS company, p_partkey AS name, p_retailprice AS cap FROM k WHERE n = 1 ORDER BY cap DESC, name LIMIT 10")
def largest_names(spark: SparkSession, sf: str) -> DataFrame:
    """The largest, one share class per company."""
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    k = V.table(spark, sf, "part").withColumn("n", n).where("n = 1")
    return k.orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select(F.col("p_brand").alias("company"), F.col("p_partkey").alias("name"), F.col("p_retailprice").alias("cap"))


@query("candidates_anti", "SELECT s_suppkey AS instrument, s_name AS name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49) AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 0)")
def candidates(spark: SparkSession, sf: str) -> DataFrame:
    out = V.table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    ok = V.table(spark, sf, "nation").where("n_regionkey <> 0").select(F.col("n_nationkey").alias("s_nationkey"))
    return V.table(spark, sf, "supplier").join(out, "s_suppkey", "left_anti").join(ok, "s_nationkey", "left_semi").select(F.col("s_suppkey").alias("instrument"), F.col("s_name").alias("name"))


@query("instruments_now", f"WITH {V.SQL_BRAND}, k AS (SELECT instrument, ts, row_number() OVER (PARTITION BY ts ORDER BY dollar_volume DESC, instrument) AS n FROM bars WHERE ts = (SELECT max(ts) FROM bars)) SELECT instrument, ts FROM k WHERE n <= 10")
def instruments_now(spark: SparkSession, sf: str) -> DataFrame:
    b = V.bars_brand(spark, sf)
    last = b.join(F.broadcast(b.agg(F.max("ts").alias("ts"))), "ts")  # one row
    return last.orderBy(F.desc("dollar_volume"), "instrument").limit(10).select("instrument", "ts")


@query("session_coverage", f"WITH {V.SQL_NATION}, d AS (SELECT count(DISTINCT ts) AS n FROM bars) SELECT instrument, count(*) AS bars, round(count(*) / (SELECT n FROM d), 6) AS coverage FROM bars GROUP BY 1 HAVING count(*) < 0.98 * (SELECT n FROM d)")
def session_coverage(spark: SparkSession, sf: str) -> DataFrame:
    b = V.bars_nation(spark, sf)
    n = F.broadcast(b.agg(F.count_distinct("ts").alias("n")))  # one row
    c = b.groupBy("instrument").agg(F.count(F.lit(1)).alias("bars")).join(n).where("bars < 0.98D * n")
    return c.select("instrument", "bars", F.round(F.col("bars") / F.col("n"), 6).alias("coverage"))


@query("list_stats", f"WITH {V.SQL_NATION}, l AS (SELECT instrument, count(*) AS n, avg(volume) AS v FROM bars GROUP BY 1) SELECT count(*) AS names, sum(CASE WHEN n > 100 THEN 1 ELSE 0 END)::BIGINT AS trading, round(min(v), 6) AS least, round(max(v), 6) AS most FROM l")
def list_stats(spark: SparkSession, sf: str) -> DataFrame:
    g = V.bars_nation(spark, sf).groupBy("instrument").agg(F.count(F.lit(1)).alias("n"), F.avg("volume").alias("v"))
    return rounded(g.agg(F.count(F.lit(1)).alias("names"), F.count_if(F.col("n") > 100).alias("trading"), F.min("v").alias("least"), F.max("v").alias("most")))


@query("company_names", r"SELECT c_custkey AS id, trim(regexp_replace(regexp_replace(regexp_replace(lower(c_name || ' Inc.'), '[^a-z0-9 ]', ' ', 'g'), '\b(inc|corp|corporation|co|company|ltd|limited|plc|sa|ag|nv|class [a-z])\b', ' ', 'g'), ' +', ' ', 'g')) AS name FROM customer")
def company_names(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), C.regular(F.concat("c_name", F.lit(" Inc."))).alias("name"))


# Results.


@query("results_series_roundtrip", f"WITH {SQL_RECORD} SELECT key, day, round(r, 8) AS r FROM record")
def series_codec(spark: SparkSession, sf: str) -> DataFrame:
    """Every value of every record after a trip through the codec."""
    return store.decode_series(store.encode_series(record(spark, sf))).select("key", "day", F.round("r", 8).alias("r"))


@query("results_frame", f"""{SQL_CORE}, s AS (SELECT key, 'sma_cross' AS strategy FROM card), b AS (SELECT key, max(days) AS bench_days FROM card GROUP BY 1)
  SELECT s.strategy, s.key, c.sharpe, c.cagr, c.max_dd, b.bench_days FROM s JOIN card c USING (key) LEFT JOIN b USING (key) WHERE c.months > 12""")
def results_frame(spark: SparkSession, sf: str) -> DataFrame:
    card = rounded(M.core(record(spark, sf)))
    s, b = card.select("key", F.lit("sma_cross").alias("strategy")), card.groupBy("key").agg(F.max("days").alias("bench_days"))
    return s.join(card, "key").join(b, "key", "left").where("months > 12").select("strategy", "key", "sharpe", "cagr", "max_dd", "bench_days")


@query("results_fingerprint", f"{SQL_CORE} SELECT count(*) AS n, max(key) AS last, round(sum(growth), 4) AS total FROM card")
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.core(record(spark, sf))).agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("last"), F.round(F.sum("growth"), 4).alias("total"))


@query("judged_checks", f"""{SQL_CORE}, k AS (SELECT key, unnest([{{'check': 'sharpe', 'value': sharpe, 'limit': 1.0}}, {{'check': 'drawdown', 'value': max_dd, 'limit': -0.1}}, {{'check': 'green', 'value': coalesce(green_active, 0), 'limit': 0.7}}]) AS x FROM card)
  SELECT key, x.check AS "check", x.value AS value, CASE WHEN x.value >= x.limit THEN 'pass' WHEN x.value >= 0.5 * x.limit THEN 'near' ELSE 'fail' END AS state FROM k""")
def judged(spark: SparkSession, sf: str) -> DataFrame:
    card = rounded(M.core(record(spark, sf)))
    row = lambda n, c, limit: F.struct(F.lit(n).alias("check"), c.alias("value"), F.lit(limit).alias("limit"))
    x = card.select("key", F.explode(F.array(row("sharpe", F.col("sharpe"), 1.0), row("drawdown", F.col("max_dd"), -0.1), row("green", F.coalesce("green_active", F.lit(0.0)), 0.7))).alias("x"))
    state = F.when(F.col("x.value") >= F.col("x.limit"), "pass").when(F.col("x.value") >= 0.5 * F.col("x.limit"), "near").otherwise("fail")
    return x.select("key", "x.check", "x.value", state.alias("state"))
