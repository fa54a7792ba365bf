"""Queries on daily records: figures, walk-forward selection and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.functions import indicators as I
from ravelin.operators import metrics as M
from ravelin.operators import selection as S
from ravelin.plans.registry import query
from ravelin.plans.signal_queries import _frame, r6
from ravelin.sources import views as V
from ravelin.sources.store import kept

W = "PARTITION BY instrument ORDER BY ts"
K = "PARTITION BY key ORDER BY day"

# A record per nation: close-to-close returns of its daily bars, damped; the benchmark is the mean of all.
_DAYS = """span AS (SELECT key, min(day) AS lo, max(day) AS hi FROM raw GROUP BY 1), days AS (SELECT key, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS day FROM span),
  record AS (SELECT key, day, coalesce(r, 0) AS r FROM days LEFT JOIN raw USING (key, day))"""
SQL_RECORD = f"{V.SQL_NATION}, raw AS (SELECT instrument AS key, ts AS day, coalesce(ln(close / lag(close) OVER ({W})), 0) * 0.02 + 0.0004 AS r FROM bars), {_DAYS}"
SQL_PATH = f"""eq AS (SELECT *, exp(sum(ln(1 + r)) OVER ({K})) AS equity FROM record), pk AS (SELECT *, greatest(max(equity) OVER ({K}), 1) AS peak FROM eq),
  path AS (SELECT *, equity / peak - 1 AS drawdown FROM pk)"""
SQL_MONTHS = """mm AS (SELECT *, date_trunc('month', day) AS month, min(day) OVER (PARTITION BY key) AS lo, max(day) OVER (PARTITION BY key) AS hi FROM record),
  months AS (SELECT key, month, exp(sum(ln(1 + r))) - 1 AS r FROM mm WHERE month >= lo AND last_day(month) <= hi::DATE GROUP BY 1, 2)"""


def record(spark: SparkSession, sf: str) -> DataFrame:
    b = V.bars_nation(spark, sf)
    r = F.coalesce(F.log(F.col("close") / F.lag("close").over(I.own())), F.lit(0.0)) * 0.02 + 0.0004
    return M.every_day(b.select(F.col("instrument").alias("key"), F.col("ts").alias("day"), r.alias("r")))


@query("daily_compounded", f"""WITH {V.sql_event()}, x AS (SELECT instrument AS key, ts, (close / lag(close) OVER ({W}) - 1) * 0.01 AS r FROM bars),
  raw AS (SELECT key, date_trunc('day', ts - INTERVAL 1 MICROSECOND) AS day, exp(sum(ln(1 + greatest(coalesce(r, 0), -0.999999)))) - 1 AS r FROM x GROUP BY 1, 2), {_DAYS} SELECT key, day, round(r, 6) AS r FROM record""")
def daily_compounded(spark: SparkSession, sf: str) -> DataFrame:
    b = V.bars_event(spark, sf).withColumn("r", (F.col("close") / F.lag("close").over(I.own()) - 1) * 0.01).withColumnRenamed("instrument", "key")
    return M.daily(b, "ts", "r").select("key", "day", r6("r").alias("r"))


@query("monthly_complete", f"WITH {SQL_RECORD}, {SQL_MONTHS} SELECT key, month::TIMESTAMP AS month, round(r, 6) AS r FROM months")
def monthly_complete(spark: SparkSession, sf: str) -> DataFrame:
    return M.monthly(record(spark, sf)).select("key", "month", r6("r").alias("r"))


@query("drawdown_path", f"WITH {SQL_RECORD}, {SQL_PATH} SELECT key, day, round(equity, 6) AS equity, round(drawdown, 6) AS drawdown FROM path")
def drawdown_path(spark: SparkSession, sf: str) -> DataFrame:
    return M.path(record(spark, sf)).select("key", "day", r6("equity").alias("equity"), r6("drawdown").alias("drawdown"))


def _longest(source: str, flag: str, order: str, name: str) -> str:
    return f"""(SELECT key, max(n) AS {name} FROM (SELECT key, island, count(*) AS n FROM (SELECT *, sum(CASE WHEN {flag} THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY {order}) AS island FROM {source})
    WHERE {flag} GROUP BY key, island) GROUP BY key)"""


SQL_CORE = f"""WITH {SQL_RECORD}, {SQL_PATH}, {SQL_MONTHS},
  d AS (SELECT key, count(*) AS days, arg_max(equity, day) AS growth, min(drawdown) AS max_dd, avg(r) AS mean, stddev_samp(r) AS sd, sqrt(avg(pow(least(r, 0), 2))) AS down, max(r) AS best_day, min(r) AS worst_day FROM path GROUP BY 1),
  m AS (SELECT key, count(*) AS months, avg((r > 0)::INT) AS green, avg((r < 0)::INT) AS red, count(*) FILTER (r > 0) / nullif(count(*) FILTER (r <> 0), 0) AS green_active, max(r) AS best_month, min(r) AS worst_month FROM months GROUP BY 1),
  card AS (SELECT key, days, round(growth, 6) AS growth, round(max_dd, 6) AS max_dd, round(best_day, 6) AS best_day, round(worst_day, 6) AS worst_day, coalesce(months, 0) AS months, round(green, 6) AS green, round(red, 6) AS red,
    round(green_active, 6) AS green_active, round(best_month, 6) AS best_month, round(worst_month, 6) AS worst_month, coalesce(red_streak, 0) AS red_streak, coalesce(underwater, 0) AS underwater,
    round(coalesce(mean / nullif(sd, 0), 0) * sqrt(365), 6) AS sharpe, round(coalesce(mean / nullif(down, 0), 0) * sqrt(365), 6) AS sortino, round(sd * sqrt(365), 6) AS ann_vol,
    round(pow(growth, 365 / days) - 1, 6) AS cagr, round(pow(growth, 365 / 12 / days) - 1, 6) AS avg_monthly
    FROM d LEFT JOIN m USING (key) LEFT JOIN {_longest('months', 'r < 0', 'month', 'red_streak')} USING (key) LEFT JOIN {_longest('path', 'drawdown < 0', 'day', 'underwater')} USING (key))"""


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query("core_scorecard", f"{SQL_CORE} SELECT * FROM card")
def core_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.core(record(spark, sf)))


@query("targets_met", f"""{SQL_CORE} SELECT key, avg_monthly >= 0.015 AS t_monthly, coalesce(green_active, 0) >= 0.7 AS t_green, max_dd >= -0.1 AS t_drawdown, sharpe >= 1 AS t_sharpe, cagr > 0.1 AS t_hold,
  (avg_monthly >= 0.015)::INT + (coalesce(green_active, 0) >= 0.7)::INT + (max_dd >= -0.1)::INT + (sharpe >= 1)::INT + (cagr > 0.1)::INT AS targets_met FROM card""")
def targets_met(spark: SparkSession, sf: str) -> DataFrame:
    card = rounded(M.core(record(spark, sf))).withColumn("beats_hold", F.col("cagr") > 0.1)
    return M.targets(card).select("key", "t_monthly", "t_green", "t_drawdown", "t_sharpe", "t_hold", "targets_met")


@query("k_ratio", f"""WITH {SQL_RECORD}, p AS (SELECT key, sum(ln(1 + r)) OVER ({K}) AS y, row_number() OVER ({K}) AS x FROM record),
  s AS (SELECT key, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, count(*) AS n FROM p GROUP BY 1)
  SELECT key, round(sxy / sxx / nullif(sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx), 0) * sqrt(365) / n, 6) AS k_ratio FROM s""")
def k_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.k_ratio(record(spark, sf)))


_BENCH = f"bench AS (SELECT day, avg(r) AS b FROM record GROUP BY day), j AS (SELECT key, day, r, coalesce(b, 0) AS b FROM record LEFT JOIN bench USING (day)), f AS (SELECT *, CASE WHEN count(r) OVER w >= 30 THEN stddev_samp(b) OVER w / nullif(stddev_samp(r) OVER w, 0) END AS k FROM j WINDOW w AS ({K} ROWS 89 PRECEDING)), e AS (SELECT *, coalesce(least(lag(k) OVER ({K}), 2), 1) AS scale FROM f)"


def benchmark(rec: DataFrame) -> DataFrame:
    mean = rec.groupBy("day").agg(F.avg("r").alias("r"))
    return rec.select("key", "day").join(mean, "day").select("key", "day", "r")


@query("equal_risk", f"WITH {SQL_RECORD}, {_BENCH} SELECT key, day, round(scale, 6)::DOUBLE AS scale, round(r * scale, 6) AS sized FROM e")
def equal_risk(spark: SparkSession, sf: str) -> DataFrame:
    rec = record(spark, sf)
    return rounded(M.equal_risk(rec, benchmark(rec)).select("key", "day", "scale", "sized"))


@query("vs_hold", f"WITH {SQL_RECORD}, {_BENCH} SELECT key, round(pow(exp(sum(ln(1 + r * scale))), 365 / count(*)) - pow(exp(sum(ln(1 + b))), 365 / count(*)), 6) AS vs_hold FROM e GROUP BY key")
def vs_hold(spark: SparkSession, sf: str) -> DataFrame:
    rec = record(spark, sf)
    return rounded(M.vs_hold(rec, benchmark(rec)))


@query("best_year", f"""WITH {SQL_RECORD}, y AS (SELECT key, year(day) AS y, exp(sum(ln(1 + r))) - 1 AS gain, count(*) AS n, sum(ln(1 + r)) AS l FROM record GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY gain DESC, y) AS nth FROM y)
  SELECT key, max(CASE WHEN nth = 1 THEN y END)::INTEGER AS year, round(exp(sum(l) * (365 / 12) / sum(n)) - 1, 6) AS avg_monthly,
    round(CASE WHEN sum(n) FILTER (nth > 1) >= 365 THEN exp(sum(l) FILTER (nth > 1) * (365 / 12) / sum(n) FILTER (nth > 1)) - 1 END, 6) AS without FROM k GROUP BY key""")
def best_year(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.best_year(record(spark, sf)))


@query("best_days_share", f"WITH {SQL_RECORD}, k AS (SELECT key, ln(1 + r) AS l, row_number() OVER (PARTITION BY key ORDER BY ln(1 + r) DESC, day) AS nth FROM record) SELECT key, round(sum(l) FILTER (nth <= 5) / nullif(sum(l), 0), 6) AS share FROM k GROUP BY 1")
def best_days(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.best_days_share(record(spark, sf)))


@query("eras_gain", f"""WITH {SQL_RECORD}, x AS (SELECT *, min(day) OVER (PARTITION BY key) AS lo FROM record), e AS (SELECT key, floor(date_diff('day', lo, day) / 730) AS era, count(*) AS n, exp(sum(ln(1 + r))) - 1 AS gain FROM x GROUP BY 1, 2)
  SELECT key, count(*) AS eras, round(avg((gain > 0)::INT), 6) AS good, round(min(gain), 6) AS worst FROM e WHERE n >= 365 GROUP BY key""")
def eras_gain(spark: SparkSession, sf: str) -> DataFrame:
    e = S.eras(record(spark, sf)).where("n >= 365")
    return rounded(e.groupBy("key").agg(F.count(F.lit(1)).alias("eras"), F.avg((F.col("gain") > 0).cast("double")).alias("good"), F.min("gain").alias("worst")))


@query("eras_rho", f"""WITH {SQL_RECORD}, x AS (SELECT *, floor((row_number() OVER (PARTITION BY key ORDER BY day) - 1) / 730) AS era FROM record), w AS (SELECT key, era, coalesce(avg(r) / nullif(stddev_samp(r), 0), 0) * sqrt(365) AS s FROM x GROUP BY 1, 2 HAVING count(*) >= 365)
  SELECT key, count(*) AS windows, round(CASE WHEN count(*) >= 3 THEN greatest(least(0.5 * avg((s > 0)::INT) + 0.3 * greatest(least(1 - stddev_samp(s) / 2, 1), 0) + 0.2 / (1 + exp(-min(s))), 1), 0) END, 6) AS rho FROM w GROUP BY key""")
def eras(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.consistency(record(spark, sf)))


@query("curve_weekly", f"""WITH {SQL_RECORD}, {SQL_PATH}, w AS (SELECT key, date_trunc('week', day)::TIMESTAMP AS week, arg_max(equity, day) AS equity, min(drawdown) AS low FROM path GROUP BY 1, 2),
  n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY week) - 1 AS i, count(*) OVER (PARTITION BY key) AS c FROM w) SELECT key, week, round(equity, 6) AS equity, round(low, 6) AS low FROM n WHERE i % ceil(c / 100) = 0 OR i = c - 1""")
def curve_weekly(spark: SparkSession, sf: str) -> DataFrame:
    w = M.path(record(spark, sf)).groupBy("key", F.date_trunc("week", "day").alias("week")).agg(F.max_by("equity", "day").alias("equity"), F.min("drawdown").alias("low"))
    n = w.withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy("week")) - 1).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("key")))
    return rounded(n.where((F.col("i") % F.ceil(F.col("c") / 100) == 0) | (F.col("i") == F.col("c") - 1)).select("key", "week", "equity", "low"))


@query("months_bp", f"WITH {SQL_RECORD}, {SQL_MONTHS} SELECT key, count(*) AS n, string_agg(round(r * 10000)::BIGINT::VARCHAR, ' ' ORDER BY month) AS bp FROM months GROUP BY key")
def months_bp(spark: SparkSession, sf: str) -> DataFrame:
    m = M.monthly(record(spark, sf)).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("month", F.round(F.col("r") * 10000).cast("long").cast("string").alias("bp")))).alias("x"))
    return m.select("key", "n", F.concat_ws(" ", "x.bp").alias("bp"))


# Trades: runs of one side of a moving-average cross, from close to close.

SQL_TRADES_OF = f"""WITH {V.SQL_NATION}, w AS (SELECT *, sign(avg(close) OVER {_frame(5)} - avg(close) OVER {_frame(20)})::INTEGER AS side FROM bars), c AS (SELECT *, CASE WHEN side IS DISTINCT FROM lag(side) OVER ({W}) THEN 1 ELSE 0 END AS ch FROM w),
  i AS (SELECT *, sum(ch) OVER ({W}) AS island FROM c), deals AS (SELECT instrument AS key, island, side, min(ts) AS entry, max(ts) AS exit, arg_min(close, ts) AS p0, arg_max(close, ts) AS p1, count(*) AS bars, 1.0 / (1 + island % 4) AS size FROM i WHERE side <> 0 GROUP BY instrument, island, side),
  made AS (SELECT *, side * (p1 / p0 - 1) AS r FROM deals)"""


def trades(spark: SparkSession, sf: str) -> DataFrame:
    from ravelin.operators.panel import runs_of

    b = V.bars_nation(spark, sf).withColumn("side", F.signum(F.avg("close").over(I.rows(5)) - F.avg("close").over(I.rows(20))).cast("int"))
    t = runs_of(b, "side").where("side <> 0").groupBy(F.col("instrument").alias("key"), "island", "side").agg(
        F.min("ts").alias("entry"), F.max("ts").alias("exit"), F.min_by("close", "ts").alias("p0"), F.max_by("close", "ts").alias("p1"), F.count(F.lit(1)).alias("bars")
    )
    return t.withColumn("size", 1.0 / (1 + F.col("island") % 4)).withColumn("r", F.col("side") * (F.col("p1") / F.col("p0") - 1))


@query("deals", f"{SQL_TRADES_OF} SELECT key, count(*) AS n, round(avg((r > 0)::INT), 6) AS win_rate, round(avg(r * size) FILTER (r > 0), 6) AS avg_win, round(avg(-r * size) FILTER (r < 0), 6) AS avg_loss, round(sum(r * size) FILTER (r > 0) / nullif(sum(-r * size) FILTER (r < 0), 0), 6) AS profit_factor FROM made GROUP BY key")
def deals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.deals(trades(spark, sf)))


@query("by_name", f"{SQL_TRADES_OF} SELECT key, count(*) AS trades, round(avg((r > 0)::INT), 6) AS won, round(exp(sum(ln(1 + greatest(r, -0.999999)))) - 1, 6) AS compounded FROM made GROUP BY key")
def by_name(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(trades(spark, sf).groupBy("key").agg(F.count(F.lit(1)).alias("trades"), F.avg((F.col("r") > 0).cast("double")).alias("won"), (M.grown("r") - 1).alias("compounded")))


@query("trade_stats", f"{SQL_TRADES_OF} SELECT key, count(*) AS n, round(avg(r), 6) AS avg_return, median(bars)::DOUBLE AS median_bars, round(count(*) / (date_diff('day', min(entry), max(exit)) / (365 / 12)), 6) AS per_month FROM made GROUP BY key")
def trade_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(trades(spark, sf).groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.avg("r").alias("avg_return"), F.expr("percentile(bars, 0.5D)").alias("median_bars"), (F.count(F.lit(1)) / (F.datediff(F.max("exit"), F.min("entry")) / F.lit(365 / 12))).alias("per_month")
    ))


@query("names_share", f"{SQL_TRADES_OF}, n AS (SELECT key, sum(r * size) AS made FROM made GROUP BY key) SELECT count(*) AS names, round(avg((made > 0)::INT), 6) AS share FROM n")
def names_share(spark: SparkSession, sf: str) -> DataFrame:
    n = trades(spark, sf).groupBy("key").agg(F.sum(F.col("r") * F.col("size")).alias("made"))
    return rounded(n.agg(F.count(F.lit(1)).alias("names"), F.avg((F.col("made") > 0).cast("double")).alias("share")))


# Walk-forward over a grid of moving-average crosses, held over all regions alike.

FASTS, SLOWS = (5, 10, 20), (40, 80, 120)
GRID = [(i, f, s) for i, (f, s) in enumerate((f, s) for f in FASTS for s in SLOWS)]
COST = 0.0002


def config_nets(spark: SparkSession, sf: str) -> DataFrame:
    """(peer, config, day, market, r): on each region, yesterday's side times the day's damped return (market), less costs."""
    b = V.bars_region(spark, sf).withColumn("r", F.coalesce((F.col("close") / F.lag("close").over(I.own()) - 1) * 0.02, F.lit(0.0)))
    b = b.select("instrument", "ts", "r", *(I.sma("close", n).alias(f"s{n}") for n in FASTS + SLOWS))
    side = [F.struct(F.lit(i).alias("config"), F.coalesce(I.cross(f"s{f}", f"s{s}"), F.lit(0.0)).alias("side")) for i, f, s in GRID]
    long_ = b.select("instrument", "ts", "r", F.explode(F.array(*side)).alias("c")).select("instrument", "ts", "r", "c.config", "c.side")
    w = Window.partitionBy("config", "instrument").orderBy("ts")
    held = F.coalesce(F.lag("side").over(w), F.lit(0.0))
    net = long_.withColumn("held", held).withColumn("before", F.coalesce(F.lag("side", 2).over(w), F.lit(0.0)))
    net = net.withColumn("net", F.col("held") * F.col("r") - F.abs(F.col("held") - F.col("before")) * COST)
    return net.select(F.col("instrument").alias("peer"), "config", F.col("ts").alias("day"), F.col("r").alias("market"), F.col("net").alias("r"))


def config_records(spark: SparkSession, sf: str) -> DataFrame:
    """(config, day, r): a configuration's mean over regions. Written once: folds, sums, choices and stitching all read it."""
    return kept(config_nets(spark, sf).groupBy("config", "day").agg(F.avg("r").alias("r")), "configs")


_SIDES = " UNION ALL ".join(f"SELECT instrument, ts, r, {i} AS config, coalesce(sign(s{f} - s{s}), 0)::DOUBLE AS side FROM smas" for i, f, s in GRID)
_SMAS = ", ".join(f"CASE WHEN count(close) OVER {_frame(n)} = {n} THEN avg(close) OVER {_frame(n)} END AS s{n}" for n in FASTS + SLOWS)
SQL_CONFIGS = f"""WITH {V.SQL_REGION}, smas AS (SELECT instrument, ts, coalesce((close / lag(close) OVER ({W}) - 1) * 0.02, 0) AS r, {_SMAS} FROM bars), sides AS ({_SIDES}),
  h AS (SELECT *, coalesce(lag(side) OVER w, 0) AS held, coalesce(lag(side, 2) OVER w, 0) AS before FROM sides WINDOW w AS (PARTITION BY config, instrument ORDER BY ts)),
  configs AS (SELECT config, ts AS day, avg(held * r - abs(held - before) * {COST}) AS r FROM h GROUP BY 1, 2),
  sp AS (SELECT min(day) AS lo, max(day) AS hi FROM configs), folds AS (SELECT f::INTEGER AS fold, lo AS train_start, lo + INTERVAL 1 DAY * (365 + f * 91) AS test_start, least(lo + INTERVAL 1 DAY * (365 + (f + 1) * 91), hi + INTERVAL 1 DAY) AS test_end
    FROM sp, (SELECT unnest(range(0, 200)) AS f) WHERE lo + INTERVAL 1 DAY * (365 + f * 91) <= hi)"""
SQL_CHOSEN = """t AS (SELECT fold, config, count(*) AS d, count(*) FILTER (r <> 0) AS n, sum(r) AS s1, sum(r * r) AS s2 FROM folds JOIN configs ON day < test_start GROUP BY 1, 2),
  q AS (SELECT fold, config, round(coalesce(s1 / d / nullif(sqrt(greatest((s2 - s1 * s1 / d) / (d - 1), 0)), 0), 0) * sqrt(365), 9) AS sharpe FROM t WHERE n >= 60),
  chosen AS (SELECT fold, arg_max(config, (sharpe, -config)) AS config, max(sharpe) AS sharpe FROM q GROUP BY fold)"""


@query("wf_config_records", f"{SQL_CONFIGS} SELECT config, day, round(r, 8) AS r FROM configs")
def wf_records(spark: SparkSession, sf: str) -> DataFrame:
    return config_records(spark, sf).select("config", "day", F.round("r", 8).alias("r"))


@query("wf_folds", f"{SQL_CONFIGS} SELECT fold, train_start, test_start, test_end FROM folds")
def wf_folds(spark: SparkSession, sf: str) -> DataFrame:
    return S.folds(config_records(spark, sf))


@query("wf_choose", f"{SQL_CONFIGS}, {SQL_CHOSEN} SELECT fold, config, round(sharpe, 6) AS sharpe FROM chosen")
def wf_choose(spark: SparkSession, sf: str) -> DataFrame:
    rec = config_records(spark, sf)
    return rounded(S.choose(rec, S.folds(rec)))


@query("wf_stitch", f"""{SQL_CONFIGS}, {SQL_CHOSEN}, p AS (SELECT f.*, c.config, coalesce(lag(c.config) OVER (ORDER BY fold) <> c.config, false) AS switch FROM folds f LEFT JOIN chosen c USING (fold)),
  d AS (SELECT fold, config, switch, test_start, unnest(generate_series(test_start, test_end - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS day FROM p)
  SELECT day, fold, config, round(CASE WHEN switch AND day = test_start THEN (1 + coalesce(r, 0)) * (1 - 0.001) - 1 ELSE coalesce(r, 0) END, 8) AS r FROM d LEFT JOIN configs USING (config, day)""")
def wf_stitch(spark: SparkSession, sf: str) -> DataFrame:
    rec = config_records(spark, sf)
    fold = S.folds(rec)
    return S.stitched(rec, fold, S.choose(rec, fold), 0.001).select("day", "fold", "config", F.round("r", 8).alias("r"))


@query("pbo_cscv", f"""{SQL_CONFIGS}, pos AS (SELECT config, r, date_diff('day', lo, day) AS i, (date_diff('day', lo, hi) + 1) // 10 AS q, (date_diff('day', lo, hi) + 1) % 10 AS o FROM configs, sp),
  b AS (SELECT config, (CASE WHEN i < o * (q + 1) THEN i // (q + 1) ELSE o + (i - o * (q + 1)) // q END)::INTEGER AS block, r FROM pos), s AS (SELECT config, block, count(*) AS n, sum(r) AS s1, sum(r * r) AS s2 FROM b GROUP BY 1, 2),
  m AS (SELECT unnest(range(0, 1024)) AS mask), k AS (SELECT mask FROM m WHERE bit_count(mask::INTEGER) = 5),
  hv AS (SELECT mask, ((mask >> block) & 1) = 1 AS inside, config, sum(n) AS n, sum(s1) AS s1, sum(s2) AS s2 FROM k, s GROUP BY 1, 2, 3),
  q AS (SELECT *, round(coalesce(s1 / n / nullif(sqrt(greatest((s2 - s1 * s1 / n) / (n - 1), 0)), 0), 0), 9) AS sh FROM hv),
  z AS (SELECT *, row_number() OVER (PARTITION BY mask, inside ORDER BY sh DESC, config) AS best, rank() OVER (PARTITION BY mask, inside ORDER BY sh) + (count(*) OVER (PARTITION BY mask, inside, sh) - 1) / 2 AS low, count(*) OVER (PARTITION BY mask, inside) AS c FROM q)
  SELECT count(*) AS splits, round(avg((o.low / (o.c + 1) <= 0.5)::INT), 6) AS pbo FROM z i JOIN z o ON o.mask = i.mask AND o.config = i.config WHERE i.inside AND i.best = 1 AND NOT o.inside""")
def pbo(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.overfitting_share(config_records(spark, sf)))


@query("plateau_neighbours", f"""{SQL_CONFIGS}, g AS (SELECT * FROM (VALUES {', '.join(f'({i}, {FASTS.index(f)}, {SLOWS.index(s)})' for i, f, s in GRID)}) t(config, a, b)),
  sh AS (SELECT config, avg(r) / stddev_samp(r) * sqrt(365) AS sharpe FROM configs GROUP BY 1)
  SELECT x.config, count(*) AS neighbours, round(avg(sharpe), 6) AS mean_sharpe FROM g x JOIN g y ON abs(x.a - y.a) + abs(x.b - y.b) = 1 JOIN sh ON sh.config = y.config GROUP BY 1""")
def plateau(spark: SparkSession, sf: str) -> DataFrame:
    grid = spark.createDataFrame(GRID, "config int, fast int, slow int")
    sharpe = config_records(spark, sf).groupBy(F.col("config").alias("neighbour")).agg((F.avg("r") / F.stddev_samp("r") * F.lit(365**0.5)).alias("sharpe"))
    return rounded(S.neighbours(grid, ["fast", "slow"]).join(sharpe, "neighbour").groupBy("config").agg(F.count(F.lit(1)).alias("neighbours"), F.avg("sharpe").alias("mean_sharpe")))


@query("peers_share", f"{SQL_CORE} SELECT key, cagr, count(*) OVER () - 1 AS peers, round((sum((cagr > 0.1)::INT) OVER () - (cagr > 0.1)::INT) / (count(*) OVER () - 1), 6) AS peers_share FROM card")
def peers_share(spark: SparkSession, sf: str) -> DataFrame:
    card = rounded(M.core(record(spark, sf))).select("key", "cagr").withColumn("list", F.lit("all"))
    return rounded(S.share_of_peers(card, ["list"], F.col("cagr") > 0.1).drop("list"))


@query("board_ordered", f"{SQL_CORE}, bo AS (SELECT key, cagr, sharpe, (avg_monthly >= 0.015)::INT + (coalesce(green_active, 0) >= 0.7)::INT + (max_dd >= -0.1)::INT + (sharpe >= 1)::INT AS targets_met FROM card) SELECT (row_number() OVER (ORDER BY cagr > 0 DESC, targets_met DESC, sharpe DESC, key))::INTEGER AS place, key, cagr, sharpe, targets_met FROM bo")
def board_ordered(spark: SparkSession, sf: str) -> DataFrame:
    card = rounded(M.core(record(spark, sf))).withColumn("beats_hold", F.lit(False))
    w = Window.orderBy(F.desc(F.col("cagr") > 0), F.desc("targets_met"), F.desc("sharpe"), "key")  # a board: one row per result
    return M.targets(card).select(F.row_number().over(w).alias("place"), "key", "cagr", "sharpe", "targets_met")
