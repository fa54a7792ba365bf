"""Queries on the data check, named lists, conditioning against other sources, and stores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.operators import checks as K
from ravelin.operators import conditioning as C
from ravelin.operators import universes as U
from ravelin.operators.panel import own
from ravelin.plans.evaluate_queries import top_members
from ravelin.plans.record_queries import SQL_RECORD, rounded
from ravelin.plans.registry import query
from ravelin.plans.signal_queries import r6
from ravelin.sources import store
from ravelin.sources import views as V

W = "OVER (PARTITION BY instrument ORDER BY ts)"

# The data check on the brands' daily bars, held while among the ten most traded of the month before.

SQL_HELD = """mon AS (SELECT instrument, date_trunc('month', ts) AS month, sum(dollar_volume) AS money FROM bars GROUP BY 1, 2),
  rk AS (SELECT instrument, month + INTERVAL 1 MONTH AS month, row_number() OVER (PARTITION BY month ORDER BY money DESC, instrument) <= 10 AS listed FROM mon),
  held AS (SELECT b.instrument, b.ts, coalesce(listed, false) AS listed FROM bars b LEFT JOIN rk ON rk.instrument = b.instrument AND rk.month = date_trunc('month', b.ts)),
  edge AS (SELECT min(ts) AS first_day, max(ts) AS last_day FROM held), hd AS (SELECT instrument, ts, ts >= last_day - INTERVAL 365 DAY AS recent FROM held, edge WHERE listed)"""
SQL_HOLES = """sp AS (SELECT instrument, min(ts) AS lo, max(ts) AS hi FROM bars GROUP BY 1), ex AS (SELECT instrument, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ts FROM sp),
  wd AS (SELECT e.instrument, e.ts, b.ts IS NULL AS gone FROM ex e LEFT JOIN (SELECT DISTINCT instrument, ts FROM bars) b USING (instrument, ts) WHERE dayofweek(e.ts) BETWEEN 1 AND 5 AND strftime(e.ts, '%m-%d') NOT IN ('12-25', '01-01')),
  hc AS (SELECT *, CASE WHEN gone IS DISTINCT FROM lag(gone) OVER (PARTITION BY instrument ORDER BY ts) THEN 1 ELSE 0 END AS ch FROM wd), hi2 AS (SELECT *, sum(ch) OVER (PARTITION BY instrument ORDER BY ts) AS island FROM hc),
  holes AS (SELECT instrument, min(ts) AS lo, max(ts) AS hi, count(*) AS n FROM hi2 WHERE gone GROUP BY instrument, island)"""


@query("expected_weekdays", f"WITH {V.SQL_BRAND}, {SQL_HOLES} SELECT instrument, count(*) AS expected, sum(gone::INT)::BIGINT AS missing FROM wd GROUP BY 1")
def expected_weekdays(spark: SparkSession, sf: str) -> DataFrame:
    b = V.bars_brand(spark, sf)
    days = K.expected_weekdays(b.groupBy("instrument").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")))
    gone = days.join(b.select("instrument", "ts").distinct().withColumn("have", F.lit(1)), ["instrument", "ts"], "left")
    return gone.groupBy("instrument").agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("have").isNull()).alias("missing"))


@query("held_inside_spans", f"WITH {V.SQL_BRAND}, {SQL_HELD}, {SQL_HOLES} SELECT h.instrument, h.lo, h.hi, h.n, count(d.ts) AS held, count(d.ts) FILTER (d.recent) AS recent FROM holes h LEFT JOIN hd d ON d.instrument = h.instrument AND d.ts BETWEEN h.lo AND h.hi GROUP BY ALL")
def held_inside(spark: SparkSession, sf: str) -> DataFrame:
    b = V.bars_brand(spark, sf)
    return K.held_inside(K.holes(b), top_members(b, 10)).select("instrument", "lo", "hi", "n", "held", "recent")


_GRID_HELD = """gd AS (SELECT i.instrument, t.ts FROM (SELECT DISTINCT instrument FROM bars) i, (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM bars) t),
  rk AS (SELECT instrument, month + INTERVAL 1 MONTH AS month, row_number() OVER (PARTITION BY month ORDER BY money DESC, instrument) <= 10 AS listed FROM (SELECT instrument, date_trunc('month', ts) AS month, sum(dollar_volume) AS money FROM bars GROUP BY 1, 2)),
  held AS (SELECT g.instrument, g.ts, coalesce(listed, false) AS listed FROM gd g LEFT JOIN rk ON rk.instrument = g.instrument AND rk.month = date_trunc('month', g.ts)),
  edge AS (SELECT min(ts) AS first_day, max(ts) AS last_day FROM held), hd AS (SELECT instrument, ts, ts >= last_day - INTERVAL 365 DAY AS recent FROM held, edge WHERE listed)"""


@query("check_list", f"""WITH {V.SQL_BRAND}, {_GRID_HELD}, {SQL_HOLES}, ever AS (SELECT DISTINCT instrument FROM hd), s AS (SELECT e.instrument, sp.lo, sp.hi, first_day, last_day FROM ever e LEFT JOIN sp USING (instrument), edge),
  st AS (SELECT *, volume = 0 AND close = lag(close) {W} AS still FROM bars), sc AS (SELECT *, CASE WHEN coalesce(still, false) IS DISTINCT FROM lag(coalesce(still, false)) {W} THEN 1 ELSE 0 END AS ch FROM st), si AS (SELECT *, sum(ch) {W} AS island FROM sc),
  spans AS (SELECT instrument, 'missing' AS kind, first_day AS a, lo - INTERVAL 4 DAY AS b FROM s WHERE lo IS NOT NULL UNION ALL SELECT instrument, 'missing', hi + INTERVAL 4 DAY, last_day FROM s WHERE lo IS NOT NULL UNION ALL SELECT instrument, 'missing', first_day, last_day FROM s WHERE lo IS NULL
    UNION ALL SELECT instrument, 'dead', min(ts), max(ts) FROM si WHERE still GROUP BY instrument, island HAVING count(*) >= 10),
  t AS (SELECT p.instrument, p.kind, p.a, p.b, count(d.ts) AS held, count(d.ts) FILTER (d.recent) AS recent FROM spans p JOIN hd d ON d.instrument = p.instrument AND d.ts BETWEEN p.a AND p.b WHERE p.a <= p.b GROUP BY ALL),
  g AS (SELECT h.instrument, h.lo, h.hi, h.n, count(d.ts) AS held, count(d.ts) FILTER (d.recent) AS recent FROM holes h JOIN hd d ON d.instrument = h.instrument AND d.ts BETWEEN h.lo AND h.hi GROUP BY ALL),
  l AS (SELECT * FROM (SELECT *, coalesce(sum(n) FILTER (n <= 10) OVER (PARTITION BY instrument), 0) AS many FROM g) WHERE n > 10 OR many > 10),
  m AS (SELECT *, count(*) OVER (PARTITION BY lo, hi) >= greatest(3, (SELECT count(*) FROM s WHERE lo IS NOT NULL) / 2) AS shared FROM l),
  tr AS (SELECT *, date_diff('day', lag(ts) {W}, ts) AS pause, open / lag(close) {W} AS moved FROM bars WHERE volume > 0 AND instrument IN (SELECT instrument FROM ever))
  SELECT instrument, kind, count(*) AS n, sum(held)::BIGINT AS held, sum(recent)::BIGINT AS recent FROM t GROUP BY 1, 2 UNION ALL SELECT instrument, 'holes', count(*), sum(held)::BIGINT, sum(recent)::BIGINT FROM m WHERE NOT shared GROUP BY 1
  UNION ALL SELECT 'most of the list', 'shared hole', n, 0, 0 FROM (SELECT DISTINCT lo, hi, n FROM m WHERE shared) UNION ALL SELECT instrument, 'stopped', date_diff('day', hi, last_day), 0, 0 FROM s WHERE last_day > hi + INTERVAL 7 DAY
  UNION ALL SELECT instrument, 'joined', count(*), 0, 0 FROM tr WHERE pause > 5 AND NOT moved BETWEEN 0.5 AND 2 GROUP BY 1""")
def check_list(spark: SparkSession, sf: str) -> DataFrame:
    """All findings of a Top-10 list whose names are held on every calendar day."""
    b = V.bars_brand(spark, sf)
    span = b.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("ts")).join(b.select("instrument").distinct())
    month = b.groupBy("instrument", F.date_trunc("month", "ts").alias("month")).agg(F.sum("dollar_volume").alias("money"))
    rank = F.row_number().over(Window.partitionBy("month").orderBy(F.desc("money"), "instrument"))
    member = month.withColumn("rank", rank).select("instrument", (F.col("month") + F.expr("INTERVAL 1 MONTH")).alias("month"), (F.col("rank") <= 10).alias("listed"))
    held = days.withColumn("month", F.date_trunc("month", "ts")).join(member, ["instrument", "month"], "left").select("instrument", "ts", F.coalesce("listed", F.lit(False)).alias("listed"))
    return K.findings(b, held)


# Named lists. What is stored: of each fixed list the names at even places, and a pair for each two nations.

_NAMES = ", ".join(f"('{n}', {i}, '{s}')" for n, names in U.LISTS.items() for i, s in enumerate(names))
_PAIRS = "pr AS (SELECT DISTINCT upper(substr(a.n_name, 1, 3)) || '/' || upper(substr(r_name, 1, 3)) AS symbol FROM nation a JOIN region ON r_regionkey = n_regionkey)"


def stored(spark: SparkSession, sf: str) -> DataFrame:
    fixed = spark.createDataFrame([(s,) for names in U.LISTS.values() for i, s in enumerate(names) if i % 2 == 0], "symbol string")
    n, r = V.table(spark, sf, "nation"), V.table(spark, sf, "region")
    pairs = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.upper(F.concat(F.substring("n_name", 1, 3), F.lit("/"), F.substring("r_name", 1, 3))).alias("symbol"))
    return fixed.unionByName(pairs)


@query("universe_fixed_lists", f"WITH l(list, place, symbol) AS (VALUES {_NAMES}), s AS (SELECT DISTINCT symbol FROM l WHERE place % 2 = 0) SELECT list, place, symbol FROM l WHERE symbol IN (SELECT symbol FROM s)")
def fixed_lists(spark: SparkSession, sf: str) -> DataFrame:
    from functools import reduce

    have = stored(spark, sf)
    return reduce(DataFrame.unionByName, [U.listed(n, have) for n in U.LISTS])


@query("universe_fx_all", f"WITH l(list, place, symbol) AS (VALUES {_NAMES}), {_PAIRS}, s AS (SELECT symbol FROM l WHERE place % 2 = 0 UNION SELECT symbol FROM pr) SELECT symbol FROM s WHERE regexp_matches(symbol, '^[A-Z]{{3}}/[A-Z]{{3}}$') AND symbol NOT IN (SELECT symbol FROM l WHERE list = 'stockhunt_commodities')")
def fx_all(spark: SparkSession, sf: str) -> DataFrame:
    return U.pairs(stored(spark, sf))


@query("universe_refused", "SELECT DISTINCT event_type AS list FROM events WHERE event_type NOT IN ('click', 'view')")
def refused(spark: SparkSession, sf: str) -> DataFrame:
    asked = V.table(spark, sf, "events").select(F.col("event_type").alias("list"))
    return U.refused(asked, spark.createDataFrame([("click",), ("view",)], "list string"))


# Conditioning against other sources.

_HRS = f"WITH {V.sql_event().replace('bars AS', 'h0 AS')}, h AS (SELECT *, date_trunc('day', ts - INTERVAL 1 HOUR) AS day FROM h0), d AS (SELECT instrument, day, arg_min(open, ts) AS open, quantile_cont(high, 0.8) AS high, quantile_cont(low, 0.2) AS low, arg_max(close, ts) AS close FROM h GROUP BY 1, 2)"


@query("conform_commodity_hourly", f"""{_HRS}, j AS (SELECT h.instrument, h.ts, h.open AS o, least(greatest(h.high, d.low), d.high) AS hi, least(greatest(h.low, d.low), d.high) AS lo, h.close AS c, d.open AS dor, d.close AS dc, (h.open > d.high OR h.open < d.low) AS off_o, (h.close > d.high OR h.close < d.low) AS off_c,
    h.ts = min(h.ts) OVER w AS f, h.ts = max(h.ts) OVER w AND h.ts = h.day + INTERVAL 24 HOUR AS l FROM h JOIN d USING (instrument, day) WINDOW w AS (PARTITION BY h.instrument, h.day)),
  k AS (SELECT *, CASE WHEN f AND off_o THEN dor ELSE least(greatest(o, lo), hi) END AS no, CASE WHEN l AND off_c THEN dc ELSE least(greatest(c, lo), hi) END AS nc FROM j)
  SELECT instrument, ts, round(no, 6) AS open, round(greatest(hi, CASE WHEN f AND off_o THEN no ELSE hi END, CASE WHEN l AND off_c THEN nc ELSE hi END), 6) AS high, round(least(lo, CASE WHEN f AND off_o THEN no ELSE lo END, CASE WHEN l AND off_c THEN nc ELSE lo END), 6) AS low, round(nc, 6) AS close FROM k""")
def commodity_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Hours held within their day's range; a first open or a last close beyond it becomes the day's."""
    h = V.bars_event(spark, sf).withColumn("day", F.date_trunc("day", F.col("ts") - F.expr("INTERVAL 1 HOUR")))
    d = h.groupBy("instrument", "day").agg(F.min_by("open", "ts").alias("open"), F.expr("percentile(high, 0.8D)").alias("high"), F.expr("percentile(low, 0.2D)").alias("low"), F.max_by("close", "ts").alias("close"))
    return rounded(C.held_within_days(h, d, F.col("day") + F.expr("INTERVAL 24 HOUR")).select("instrument", "ts", "open", "high", "low", "close"))


@query("etf_daily_reconciled", f"""{_HRS}, v AS (SELECT instrument, day, arg_min(open, ts) AS vo, max(high) AS vh, min(low) AS vl, arg_max(close, ts) AS vc, median(close) AS m FROM h GROUP BY 1, 2),
  b AS (SELECT instrument, day, open * k AS open, high * k AS high, low * k AS low, close * k AS close FROM (SELECT *, CASE WHEN day(day) % 5 = 0 THEN 3 ELSE 1 END AS k FROM d)), j AS (SELECT b.*, v.*, m < low - 0.01 OR m > high + 0.01 AS off FROM b LEFT JOIN v ON v.instrument = b.instrument AND v.day = b.day)
  SELECT instrument, day, coalesce(off, false) AS taken, round(CASE WHEN off THEN vo ELSE open END, 6) AS open, round(CASE WHEN off THEN vh ELSE high END, 6) AS high, round(CASE WHEN off THEN vl ELSE low END, 6) AS low, round(CASE WHEN off THEN vc ELSE close END, 6) AS close FROM j""")
def etf_reconciled(spark: SparkSession, sf: str) -> DataFrame:
    """Days whose bar the venues' session contradicts take the session's prices."""
    h = V.bars_event(spark, sf).withColumn("day", F.date_trunc("day", F.col("ts") - F.expr("INTERVAL 1 HOUR")))
    k = F.when(F.dayofmonth("day") % 5 == 0, 3).otherwise(1)
    d = h.groupBy("instrument", "day").agg(F.min_by("open", "ts").alias("open"), F.expr("percentile(high, 0.8D)").alias("high"), F.expr("percentile(low, 0.2D)").alias("low"), F.max_by("close", "ts").alias("close"))
    d = d.withColumns({c: F.col(c) * k for c in ("open", "high", "low", "close")})
    return rounded(C.reconciled(d, h, 0.01).select("instrument", "day", "taken", "open", "high", "low", "close"))


_MIN = f"WITH {V.sql_event('1 minute').replace('bars AS', 'm0 AS').replace('ticks AS', 'ticks AS')}, m AS (SELECT instrument, ts, open, high, low, close, date_trunc('hour', ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR AS hour FROM m0)"


@query("minutes_conformed", f"""{_MIN}, mh AS (SELECT instrument, hour, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close FROM m GROUP BY 1, 2),
  st AS (SELECT instrument, hour AS ts, open, high, low, CASE WHEN hour(hour) % 6 = 0 THEN close * 1.01 ELSE close END AS close FROM mh WHERE hour(hour) % 7 <> 0), kept AS (SELECT * FROM m WHERE hour(hour) % 5 <> 0),
  mk AS (SELECT instrument, hour, arg_max(close, ts) AS c FROM kept GROUP BY 1, 2), sp AS (SELECT k.instrument, min(hour) AS lo, max(hour) AS hi FROM kept k JOIN st ON st.instrument = k.instrument AND st.ts = k.hour GROUP BY 1),
  j AS (SELECT st.*, mk.c IS NULL AS empty, abs(mk.c / st.close - 1) > 0.001 AS bad FROM st LEFT JOIN mk ON mk.instrument = st.instrument AND mk.hour = st.ts JOIN sp ON sp.instrument = st.instrument AND st.ts BETWEEN sp.lo AND sp.hi)
  SELECT instrument, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, 'hour' AS source FROM j WHERE empty OR bad
  UNION ALL SELECT k.instrument, k.ts, round(k.open, 6), round(k.high, 6), round(k.low, 6), round(k.close, 6), 'minute' FROM kept k JOIN j ON j.instrument = k.instrument AND j.ts = k.hour WHERE NOT empty AND NOT bad""")
def minutes_conformed(spark: SparkSession, sf: str) -> DataFrame:
    """Minutes of hours that they make; other hours, and those without minutes between the first and the last, as one bar."""
    m = V.bars_event(spark, sf, "1 minute").withColumn("hour", F.date_trunc("hour", F.col("ts") - F.expr("INTERVAL 1 MICROSECOND")) + F.expr("INTERVAL 1 HOUR"))
    whole = m.groupBy("instrument", F.col("hour").alias("ts")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"))
    hours = whole.where(F.hour("ts") % 7 != 0).withColumn("close", F.when(F.hour("ts") % 6 == 0, F.col("close") * 1.01).otherwise(F.col("close")))
    return rounded(C.minutes_conformed(m.where(F.hour("hour") % 5 != 0), hours, 0.001, ("close",)))


@query("two_sided_quotes", f"WITH {V.sql_event('1 hour')} SELECT instrument, count(*) AS hours FROM bars WHERE high - open > 0 AND close - low > 0 GROUP BY 1")
def two_sided(spark: SparkSession, sf: str) -> DataFrame:
    """Hours with a spread over nothing at both ends."""
    b = V.bars_event(spark, sf).withColumn("spread_open", F.col("high") - F.col("open")).withColumn("spread_close", F.col("close") - F.col("low"))
    return C.two_sided(b).groupBy("instrument").agg(F.count(F.lit(1)).alias("hours"))


@query("restamped_equity_hours", f"""WITH {V.sql_event('30 minutes')}, e AS (SELECT DISTINCT ts FROM bars), z AS (SELECT ts, timezone('America/New_York', timezone('UTC', ts)) AS ny, timezone('Europe/London', timezone('UTC', ts)) > ts AS summer, minute(ts) = 0 AS whole FROM e),
  p AS (SELECT *, date_trunc('day', ny) AS day FROM z) SELECT ts, CASE WHEN day < TIMESTAMP '2024-01-06' THEN CASE WHEN whole THEN ts + INTERVAL 1 MINUTE * (CASE WHEN summer THEN -30 ELSE 30 END) END WHEN day < TIMESTAMP '2024-01-20' THEN CASE WHEN NOT whole THEN NULL WHEN hour(ny) = 9 THEN ts + INTERVAL 30 MINUTE ELSE ts END ELSE ts END AS start FROM p""")
def restamped(spark: SparkSession, sf: str) -> DataFrame:
    """Where hours really start, by three periods of a vendor's labels."""
    t = V.bars_event(spark, sf, "30 minutes").select("ts").distinct()
    return t.select("ts", C.equity_hour_start(F.col("ts"), "2024-01-06", "2024-01-20").alias("start"))


@query("live_series", f"WITH {V.SQL_BRAND}, e AS (SELECT instrument, max(ts) AS last_ts FROM bars GROUP BY 1), r AS (SELECT quantile_cont(epoch(last_ts), 0.9) AS ref FROM e) SELECT instrument, last_ts, ref - epoch(last_ts) <= 3 * 86400 AS live FROM e, r")
def live_series(spark: SparkSession, sf: str) -> DataFrame:
    """Series that end no more than three days before the 90th percentile of ends."""
    e = V.bars_brand(spark, sf).groupBy("instrument").agg(F.max("ts").alias("last_ts"))
    return C.live(e, 3).select("instrument", "last_ts", "live")


@query("daily_to_intraday_seats", f"""WITH {V.sql_event('1 hour')}, d AS (SELECT instrument, date_trunc('day', ts - INTERVAL 1 MICROSECOND) AS day, sum(volume) AS v FROM bars GROUP BY 1, 2), k AS (SELECT instrument, day, row_number() OVER (PARTITION BY day ORDER BY v DESC, instrument) <= 2 AS seated FROM d)
  SELECT b.instrument, b.ts, k.seated FROM bars b JOIN k ON k.instrument = b.instrument AND k.day = date_trunc('day', b.ts - INTERVAL 1 MICROSECOND)""")
def intraday_seats(spark: SparkSession, sf: str) -> DataFrame:
    """A day's seats hold on all of its hours."""
    b = V.bars_event(spark, sf).withColumn("day", F.date_trunc("day", F.col("ts") - F.expr("INTERVAL 1 MICROSECOND")))
    d = b.groupBy("instrument", "day").agg(F.sum("volume").alias("v"))
    k = d.select("instrument", "day", (F.row_number().over(Window.partitionBy("day").orderBy(F.desc("v"), "instrument")) <= 2).alias("seated"))
    return b.join(k, ["instrument", "day"]).select("instrument", "ts", "seated")


# Stores.


@query("meta_roundtrip", f"WITH {V.SQL_REGION} SELECT instrument, '1d' AS timeframe, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS bars FROM bars GROUP BY 1")
def meta_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """What a store knows of its series, written twice: the later row of a series replaces the earlier."""
    root = f"{store.shared_dir(spark)}/meta-{uuid.uuid4().hex}"
    m = V.bars_region(spark, sf).groupBy("instrument").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("bars")).withColumn("timeframe", F.lit("1d"))
    store.write_meta(m.withColumn("bars", F.lit(0).cast("long")), root, 1)
    store.write_meta(m, root, 2)
    return store.read_meta(spark, root).select("instrument", "timeframe", "first_ts", "last_ts", "bars")


@query("results_upsert", f"WITH {SQL_RECORD}, c AS (SELECT key, count(*) AS n, sum(r) AS s FROM record GROUP BY 1) SELECT key, CASE WHEN key < 'I' THEN 2 ELSE 1 END AS run, n AS days, round(CASE WHEN key < 'I' THEN s * 2 ELSE s END, 6) AS total FROM c")
def results_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Results of a second run replace those of the first with the same key, and only those."""
    from ravelin.plans.record_queries import record

    root = f"{store.shared_dir(spark)}/results-{uuid.uuid4().hex}"
    one = record(spark, sf).groupBy("key").agg(F.count(F.lit(1)).alias("days"), F.sum("r").alias("total"))
    store.upsert_results(one.withColumn("run", F.lit(1)), root, ["key"])
    store.upsert_results(one.where("key < 'I'").withColumn("run", F.lit(2)).withColumn("total", F.col("total") * 2), root, ["key"])
    return store.read_results(spark, root).select("key", "run", "days", r6("total").alias("total"))


@query("trades_sink", f"WITH {V.SQL_TRADES} SELECT ts, count(*) AS n, round(sum(money), 2) AS money FROM trades GROUP BY 1")
def trades_sink(spark: SparkSession, sf: str) -> DataFrame:
    root = f"{store.shared_dir(spark)}/trades-{uuid.uuid4().hex}"
    store.write_trades(V.trades(spark, sf), root)
    return spark.read.parquet(root).groupBy("ts").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("money"), 2).alias("money"))


@query("seeded_union", f"WITH {V.SQL_REGION}, u AS (SELECT *, 1 AS f FROM bars WHERE day(ts) <= 20 UNION ALL SELECT instrument, ts, open, high, low, close * 2, volume, dollar_volume, 2 FROM bars WHERE day(ts) >= 15), k AS (SELECT *, row_number() OVER (PARTITION BY instrument, ts ORDER BY f DESC) AS nth FROM u) SELECT instrument, ts, round(close, 6) AS close FROM k WHERE nth = 1")
def seeded_union(spark: SparkSession, sf: str) -> DataFrame:
    """Old files into one store: the later file's bar stays."""
    b = V.bars_region(spark, sf)
    return C.seeded(b.where(F.dayofmonth("ts") <= 20), b.where(F.dayofmonth("ts") >= 15).withColumn("close", F.col("close") * 2)).select("instrument", "ts", r6("close").alias("close"))


@query("cost_typical", f"WITH {V.SQL_NATION}, r AS (SELECT instrument, ts, (high - low) / open * 0.01 AS rate, max(ts) OVER (PARTITION BY instrument) AS last_ts FROM bars) SELECT instrument, round(median(rate) * 10000, 4) AS bps FROM r WHERE ts > last_ts - INTERVAL 365 DAY GROUP BY 1")
def cost_typical(spark: SparkSession, sf: str) -> DataFrame:
    """The median rate at the open over a series' last year, in basis points."""
    b = V.bars_nation(spark, sf).withColumn("rate", (F.col("high") - F.col("low")) / F.col("open") * 0.01).withColumn("last_ts", F.max("ts").over(Window.partitionBy("instrument")))
    return b.where(F.col("ts") > F.col("last_ts") - F.expr("INTERVAL 365 DAY")).groupBy("instrument").agg(F.round(F.expr("percentile(rate, 0.5D)") * 10000, 4).alias("bps"))


@query("nearest_rate", f"WITH {V.SQL_REGION}, q AS (SELECT instrument, ts, CASE WHEN day(ts) % 4 = 1 AND instrument <> 'ASIA' THEN (high - low) / open END AS rate FROM bars) SELECT instrument, ts, round(coalesce(last_value(rate IGNORE NULLS) {W}, first_value(rate IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0), 6) AS rate FROM q")
def nearest_rate(spark: SparkSession, sf: str) -> DataFrame:
    """A bar without a quote takes the last one before it, else the next, else nothing."""
    rate = F.when((F.dayofmonth("ts") % 4 == 1) & (F.col("instrument") != "ASIA"), (F.col("high") - F.col("low")) / F.col("open"))
    b = V.bars_region(spark, sf).withColumn("rate", rate)
    ahead = F.first("rate", ignorenulls=True).over(own().rowsBetween(0, Window.unboundedFollowing))
    return b.select("instrument", "ts", r6(F.coalesce(F.last("rate", ignorenulls=True).over(own()), ahead, F.lit(0.0))).alias("rate"))


# Ranked lists: the suppliers of each region by what they traded, a silent one replaced at once.

LIST_SIZE = 5
_NAMES = f"""WITH RECURSIVE {V.SQL_TRADES}, bars AS (
    SELECT r_name AS list, s_name AS instrument, ts, round(sum(money), 4) AS dollar_volume
    FROM trades JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2, 3),
  money AS (SELECT *, round(avg(dollar_volume) OVER (PARTITION BY list, instrument ORDER BY ts ROWS BETWEEN 89 PRECEDING AND CURRENT ROW), 4) AS money, lead(ts) OVER (PARTITION BY list, instrument ORDER BY ts) AS after FROM bars),
  last AS (SELECT list, instrument, date_trunc('month', ts) + INTERVAL 1 MONTH AS month, max(ts) AS ts, arg_max(money, ts) AS money FROM money GROUP BY 1, 2, 3),
  months AS (SELECT list, month AS moment, list(instrument ORDER BY money DESC, instrument) AS ranked FROM last WHERE ts + INTERVAL 14 DAY > month GROUP BY 1, 2),
  ends AS (SELECT list, max(ts) AS last FROM bars GROUP BY 1),
  silent AS (SELECT list, instrument, ts + INTERVAL 14 DAY AS moment, after AS until FROM money JOIN ends USING (list) WHERE (after IS NULL OR after > ts + INTERVAL 14 DAY) AND ts + INTERVAL 14 DAY <= last),
  days AS (SELECT list, moment, list(instrument ORDER BY instrument) AS gone FROM silent GROUP BY 1, 2),
  quiet AS (SELECT d.list, d.moment, any_value(gone) AS gone, list(s.instrument) AS mute FROM days d JOIN silent s ON s.list = d.list AND s.moment <= d.moment AND (s.until IS NULL OR s.until > d.moment) GROUP BY 1, 2),
  events AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY moment, kind) AS k FROM (
    SELECT list, moment, 0 AS kind, NULL::VARCHAR[] AS ranked, gone, mute FROM quiet UNION ALL SELECT list, moment, 1, ranked, NULL, NULL FROM months)),
  walk AS (
    SELECT list, 0::BIGINT AS k, NULL::TIMESTAMP AS moment, []::VARCHAR[] AS members, []::VARCHAR[] AS ranked FROM ends
    UNION ALL
    SELECT list, k, moment, CASE WHEN kind = 1 THEN kept || list_filter(ranked, lambda x: NOT list_contains(kept, x))[1:{{n}} - len(kept)]
        ELSE stay || list_filter(ranked, lambda x: NOT list_contains(stay, x) AND NOT list_contains(mute, x))[1:len(members) - len(stay)] END, ranked FROM (
      SELECT e.list, e.k, e.moment::TIMESTAMP AS moment, e.kind, w.members, coalesce(e.ranked, w.ranked) AS ranked, e.mute, list_filter(w.members, lambda x: NOT list_contains(coalesce(e.gone, []), x)) AS stay,
        (e.ranked[1:{{core}}] || list_filter(e.ranked[{{core}} + 1:{{edge}}], lambda x: list_contains(w.members, x)))[1:{{n}}] AS kept
      FROM walk w JOIN events e ON e.list = w.list AND e.k = w.k + 1)),
  held AS (SELECT list, k, moment, unnest(members) AS instrument FROM walk),
  runs AS (SELECT *, k - row_number() OVER (PARTITION BY list, instrument ORDER BY k) AS island FROM held),
  spans AS (SELECT list, instrument, island, min(moment) AS start, max(k) + 1 AS over FROM runs GROUP BY 1, 2, 3)
  SELECT s.list, s.instrument, s.start, e.moment::TIMESTAMP AS "end" FROM spans s LEFT JOIN events e ON e.list = s.list AND e.k = s.over""".format(n=LIST_SIZE, core=int(LIST_SIZE / 1.5), edge=int(LIST_SIZE * 1.5))


def region_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars of suppliers; the region is the list that a supplier belongs to."""
    supplier = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("instrument"), F.col("s_nationkey").alias("n_nationkey"))
    region = V.table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("list"))
    of = supplier.join(V.table(spark, sf, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey").join(region, "n_regionkey").select("l_suppkey", "instrument", "list")
    return V.ohlcv(V.trades(spark, sf).join(of, "l_suppkey"), "list", "instrument", "ts")


@query("list_members", _NAMES)
def list_members(spark: SparkSession, sf: str) -> DataFrame:
    """Who is among the five most traded suppliers of each region, and from when to when."""
    from ravelin.operators.membership import spans_of_members

    return spans_of_members(region_suppliers(spark, sf), LIST_SIZE)


@query("list_by_name")
def list_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """An evaluation of a list by its name: the whole grid of a cross on the five most traded suppliers of a region."""
    from ravelin.operators.membership import resolved
    from ravelin.plans.evaluate import evaluate
    from ravelin.plans.strategies import STRATEGIES

    bars, member = resolved(f"EUROPE_top{LIST_SIZE}", region_suppliers(spark, sf))
    e = evaluate(bars, STRATEGIES["sma_cross"], member=member)
    return rounded(e.card.select("key", "days", "sharpe", "cagr", "max_dd", "vs_hold", "targets_met"))
