"""Queries on what a research desk reads: money with cash, windows that roll, protocols, ledgers, the judged board and its read model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.functions import indicators as I
from ravelin.operators import joins as J
from ravelin.operators import metrics as M
from ravelin.operators import panel as P
from ravelin.operators import selection as S
from ravelin.plans import robust
from ravelin.plans.record_queries import GRID, SQL_CONFIGS, SQL_CORE, SQL_RECORD, config_records, record, rounded
from ravelin.plans.registry import query
from ravelin.plans.signal_queries import _frame, r6
from ravelin.plans.strategies import STRATEGIES
from ravelin.sources import views as V

W = "OVER (PARTITION BY instrument ORDER BY ts)"
_SHARPE = "coalesce(avg(r) / nullif(stddev_samp(r), 0), 0) * sqrt(365)"


@query("with_cash", f"WITH {SQL_RECORD}, g AS (SELECT *, 0.5 + (day(day) % 11) / 10.0 AS gross, 0.03 / 365 AS rf FROM record) SELECT key, day, round(r + (1 - gross) * CASE WHEN gross <= 1 THEN rf ELSE rf + 0.015 / 365 END, 10) AS cash, round(r + rf, 10) AS margined FROM g")
def with_cash(spark: SparkSession, sf: str) -> DataFrame:
    """Returns with idle equity at the bill rate and borrowed money at the rate and a spread; margined: all equity at the rate."""
    g = record(spark, sf).withColumn("gross", 0.5 + (F.dayofmonth("day") % 11) / 10.0).withColumn("rf", F.lit(0.03 / 365))
    return g.select("key", "day", F.round(M.with_cash("r", "gross", "rf"), 10).alias("cash"), F.round(M.with_cash("r", "gross", "rf", margined=True), 10).alias("margined"))


@query("wf_folds_rolling", f"{SQL_CONFIGS} SELECT fold, greatest(train_start, test_start - INTERVAL 365 DAY) AS train_start, test_start, test_end FROM folds")
def rolling_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Windows whose training is the year before, not all of the past."""
    return S.folds(config_records(spark, sf), train=365)


_PICK = """t AS (SELECT fold, config, count(*) AS d, count(*) FILTER (r <> 0) AS n, sum(r) AS s1, sum(r * r) AS s2 FROM {f} JOIN configs ON day < test_start AND day >= train_start GROUP BY 1, 2),
  q AS (SELECT fold, config, round(coalesce(s1 / d / nullif(sqrt(greatest((s2 - s1 * s1 / d) / (d - 1), 0)), 0), 0) * sqrt(365), 9) AS sharpe FROM t WHERE n >= 60), c AS (SELECT fold, arg_max(config, (sharpe, -config)) AS config FROM q GROUP BY fold)"""


@query("rolling_vs_growing", f"""{SQL_CONFIGS}, rf AS (SELECT fold, greatest(train_start, test_start - INTERVAL 365 DAY) AS train_start, test_start, test_end FROM folds), {_PICK.format(f='folds')}, {_PICK.format(f='rf').replace('t AS', 't2 AS').replace('FROM t WHERE', 'FROM t2 WHERE').replace('q AS', 'q2 AS').replace('FROM q GROUP', 'FROM q2 GROUP').replace('c AS', 'c2 AS')},
  a AS (SELECT day, r FROM folds f JOIN c USING (fold) JOIN configs x ON x.config = c.config AND day >= test_start AND day < test_end), b AS (SELECT day, r FROM folds f JOIN c2 c USING (fold) JOIN configs x ON x.config = c.config AND day >= test_start AND day < test_end)
  SELECT count(*) AS days, round(avg(a.r) / stddev_samp(a.r) * sqrt(365), 6) AS growing, round(avg(b.r) / stddev_samp(b.r) * sqrt(365), 6) AS rolling, round(corr(a.r, b.r), 6) AS alike FROM a JOIN b USING (day)""")
def rolling_vs_growing(spark: SparkSession, sf: str) -> DataFrame:
    """The same grid under both schemes, day by day."""
    rec = config_records(spark, sf)
    days = {}
    for name, fold in (("a", S.folds(rec)), ("b", S.folds(rec, train=365))):
        chosen = S.choose_within(rec, fold)
        days[name] = fold.join(chosen, "fold").join(rec, "config").where((F.col("day") >= F.col("test_start")) & (F.col("day") < F.col("test_end"))).select("day", F.col("r").alias(name))
    ratio = lambda c: F.avg(c) / F.stddev_samp(c) * F.lit(365**0.5)
    return rounded(days["a"].join(days["b"], "day").agg(F.count(F.lit(1)).alias("days"), ratio("a").alias("growing"), ratio("b").alias("rolling"), F.corr("a", "b").alias("alike")))


@query("seventy_thirty", f"""{SQL_CONFIGS}, n AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY day) AS i, count(*) OVER (PARTITION BY config) AS c FROM configs), e AS (SELECT config, round({_SHARPE}, 9) AS late FROM n WHERE i > floor(c * 0.7) GROUP BY 1), w AS (SELECT config, round({_SHARPE}, 9) AS whole FROM configs GROUP BY 1)
  SELECT arg_max(config, (late, -config)) AS picked, max(late) AS late, round(median(late), 6) AS median_late, arg_max(whole, (late, -config)) AS shown, count(*) AS configs FROM e JOIN w USING (config)""")
def seventy_thirty(spark: SparkSession, sf: str) -> DataFrame:
    """The protocol that picks the best of a grid on the last 30 % and shows it on all: what it picks, and what a typical one does."""
    w = Window.partitionBy("config")
    n = config_records(spark, sf).withColumn("i", F.row_number().over(w.orderBy("day"))).withColumn("c", F.count(F.lit(1)).over(w))
    sharpe = lambda late: F.round(M.ratio(F.avg(F.when(late, F.col("r"))), F.stddev_samp(F.when(late, F.col("r")))) * F.lit(365**0.5), 9)
    x = n.groupBy("config").agg(sharpe(F.col("i") > F.floor(F.col("c") * 0.7)).alias("late"), sharpe(F.lit(True)).alias("whole"))
    best = F.struct("late", -F.col("config"))
    return x.agg(F.max_by("config", best).alias("picked"), F.max("late").alias("late"), r6(F.expr("percentile(late, 0.5D)")).alias("median_late"), F.max_by("whole", best).alias("shown"), F.count(F.lit(1)).alias("configs"))


@query("portfolio_combine", f"""WITH {SQL_RECORD}, mm AS (SELECT key, date_trunc('month', day) AS month, exp(sum(ln(1 + r))) - 1 AS r FROM record GROUP BY 1, 2), s AS (SELECT key, {_SHARPE.replace('365', '12')} AS sharpe FROM mm GROUP BY 1), t AS (SELECT key FROM s ORDER BY sharpe DESC, key LIMIT 5),
  p AS (SELECT month, avg(r) AS r FROM mm WHERE key IN (SELECT key FROM t) GROUP BY 1) SELECT count(*) AS months, round(avg(r), 8) AS mean, round(stddev_samp(r), 8) AS sd, round(min(r), 8) AS worst, round(avg((r > 0)::INT), 6) AS green FROM p""")
def combine(spark: SparkSession, sf: str) -> DataFrame:
    """The five best records by monthly ratio, held alike: the figures of all their months."""
    m = record(spark, sf).groupBy("key", F.date_trunc("month", "day").alias("month")).agg((M.grown("r") - 1).alias("r"))
    s = m.groupBy("key").agg((M.ratio(F.avg("r"), F.stddev_samp("r")) * F.lit(12**0.5)).alias("sharpe"))
    top = s.orderBy(F.desc("sharpe"), "key").limit(5)
    p = m.join(top.select("key"), "key", "left_semi").groupBy("month").agg(F.avg("r").alias("r"))
    return p.agg(F.count(F.lit(1)).alias("months"), F.round(F.avg("r"), 8).alias("mean"), F.round(F.stddev_samp("r"), 8).alias("sd"), F.round(F.min("r"), 8).alias("worst"), r6(F.avg((F.col("r") > 0).cast("double"))).alias("green"))


@query("portfolio_correlation", f"WITH {SQL_RECORD}, mm AS (SELECT key, date_trunc('month', day) AS month, exp(sum(ln(1 + r))) - 1 AS r FROM record GROUP BY 1, 2) SELECT a.key AS a, b.key AS b, round(corr(a.r, b.r), 6) AS rho FROM mm a JOIN mm b USING (month) WHERE a.key < b.key GROUP BY 1, 2")
def correlation(spark: SparkSession, sf: str) -> DataFrame:
    """Correlations of a portfolio's members by month."""
    m = record(spark, sf).groupBy("key", F.date_trunc("month", "day").alias("month")).agg((M.grown("r") - 1).alias("r"))
    return m.select("month", F.col("key").alias("a"), F.col("r").alias("ra")).join(m.select("month", F.col("key").alias("b"), F.col("r").alias("rb")), "month").where("a < b").groupBy("a", "b").agg(r6(F.corr("ra", "rb")).alias("rho"))


_SIDE = f"sd AS (SELECT *, coalesce(sign(avg(close) OVER {_frame(5)} - avg(close) OVER {_frame(20)}), 0)::INTEGER AS side FROM bars)"


def sided(spark: SparkSession, sf: str) -> DataFrame:
    d = F.avg("close").over(I.rows(5)) - F.avg("close").over(I.rows(20))
    return V.bars_region(spark, sf).withColumn("side", F.coalesce(F.signum(d), F.lit(0.0)).cast("int"))


@query("spans_with_exits", f"""WITH {V.SQL_REGION}, {_SIDE}, x AS (SELECT *, low < 0.5 * lag(close) {W} AS out FROM sd), c AS (SELECT *, CASE WHEN side IS DISTINCT FROM lag(side) {W} OR lag(out) {W} THEN 1 ELSE 0 END AS ch FROM x), i AS (SELECT *, sum(ch) {W} AS island FROM c)
  SELECT instrument, side, min(ts) AS start, max(ts) AS "end", count(*) AS bars, bool_or(coalesce(out, false)) AS exited FROM i WHERE side <> 0 GROUP BY instrument, island, side""")
def spans_with_exits(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of one side, which an exit within a bar ends too."""
    x = sided(spark, sf).withColumn("out", F.coalesce(F.col("low") < 0.5 * F.lag("close").over(P.own()), F.lit(False)))
    new = ~F.col("side").eqNullSafe(F.lag("side").over(P.own())) | F.coalesce(F.lag("out").over(P.own()), F.lit(False))
    i = x.withColumn("ch", new.cast("int")).withColumn("island", F.sum("ch").over(P.own())).where("side <> 0")
    return i.groupBy("instrument", "island", "side").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("bars"), F.max("out").alias("exited")).drop("island")


_DEALS = f"""{_SIDE}, c AS (SELECT *, CASE WHEN side IS DISTINCT FROM lag(side) {W} THEN 1 ELSE 0 END AS ch FROM sd), i AS (SELECT *, sum(ch) {W} AS island FROM c), tr AS (SELECT instrument, side, island, min(ts) AS start, max(ts) AS "end" FROM i WHERE side <> 0 GROUP BY ALL)"""


@query("trade_money", f"""WITH {V.SQL_NATION}, {V.SQL_SETTLEMENTS}, {_DEALS} SELECT t.instrument, t.start, t.side, count(s.rate) AS pieces, round(coalesce(sum(-t.side * s.rate), 0), 12) AS made FROM tr t LEFT JOIN settlements s ON s.instrument = t.instrument AND s.settle BETWEEN t.start AND t."end" GROUP BY ALL""")
def trade_money(spark: SparkSession, sf: str) -> DataFrame:
    """What settles while a trade is open, to the trade that covers it: the last one begun by then, if it hasn't ended."""
    d = F.avg("close").over(I.rows(5)) - F.avg("close").over(I.rows(20))
    b = V.bars_nation(spark, sf).withColumn("side", F.coalesce(F.signum(d), F.lit(0.0)).cast("int"))
    t = P.runs_of(b, "side").where("side <> 0").groupBy("instrument", "side", "island").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    at = J.as_of(V.settlements(spark, sf), t.withColumn("begun", F.col("start")), "instrument", "settle", "start", ["begun", "end", "side"])
    paid = at.where(F.col("settle") <= F.col("end")).groupBy("instrument", F.col("begun").alias("start")).agg(F.count(F.lit(1)).alias("pieces"), F.sum(-F.col("side") * F.col("rate")).alias("made"))
    out = t.join(paid, ["instrument", "start"], "left")
    return out.select("instrument", "start", "side", F.coalesce("pieces", F.lit(0)).alias("pieces"), F.round(F.coalesce("made", F.lit(0.0)), 12).alias("made"))


@query("bought_on", f"WITH {V.SQL_NATION}, l AS (SELECT instrument, ts, close, row_number() OVER (PARTITION BY instrument ORDER BY ts DESC) AS n FROM bars WHERE ts < TIMESTAMP '1996-06-01') SELECT b.instrument, l.ts AS bought, count(*) AS bars, round(arg_max(b.close, b.ts) / max(l.close) - 1, 6) AS gain FROM bars b JOIN l ON l.instrument = b.instrument AND l.n = 1 WHERE b.ts >= TIMESTAMP '1996-06-01' GROUP BY 1, 2")
def bought_on(spark: SparkSession, sf: str) -> DataFrame:
    """Names held from their last close before a day on."""
    b, day = V.bars_nation(spark, sf), F.lit("1996-06-01").cast("timestamp")
    last = b.where(F.col("ts") < day).groupBy("instrument").agg(F.max("ts").alias("bought"), F.max_by("close", "ts").alias("paid"))
    return b.where(F.col("ts") >= day).join(last, "instrument").groupBy("instrument", "bought").agg(F.count(F.lit(1)).alias("bars"), r6(F.max_by("close", "ts") / F.max("paid") - 1).alias("gain"))


@query("cost_multiple", "SELECT round(greatest(3, coalesce(max(stress / nullif(modelled, 0)), 0)), 6) AS multiple FROM (VALUES ('perp', 6.0::DOUBLE, NULL::DOUBLE), ('commodity', 2.0, 10.0), ('fx', 1.0, NULL), ('none', 0.0, 10.0)) t(class, modelled, stress)")
def cost_multiple(spark: SparkSession, sf: str) -> DataFrame:
    t = spark.createDataFrame([("perp", 6.0, None), ("commodity", 2.0, 10.0), ("fx", 1.0, None), ("none", 0.0, 10.0)], "class string, modelled double, stress double")
    return t.agg(F.round(robust.cost_multiple(t), 6).alias("multiple"))


_CONFIGS = ", ".join(f"({i}, {f}, {s})" for i, f, s in [*GRID, *GRID[:4]])


@query("config_dedupe", f"SELECT min(config) AS config, fast, slow FROM (VALUES {_CONFIGS}) t(config, fast, slow) GROUP BY 2, 3")
def config_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Configurations asked for twice run once."""
    return spark.createDataFrame([*GRID, *GRID[:4]], "config int, fast int, slow int").groupBy("fast", "slow").agg(F.min("config").alias("config"))


@query("results_and_too_short", f"{SQL_CORE} SELECT key, days, CASE WHEN days < 2400 THEN NULL ELSE sharpe END AS sharpe, CASE WHEN days < 2400 THEN 'too short' END AS note FROM card")
def results_and_short(spark: SparkSession, sf: str) -> DataFrame:
    """Scored results and, beside them, those with a record too short to score."""
    card = rounded(M.core(record(spark, sf))).select("key", "days", "sharpe")
    scored = card.where("days >= 2400").withColumn("note", F.lit(None).cast("string"))
    return scored.unionByName(card.where("days < 2400").select("key", "days", F.lit(None).cast("double").alias("sharpe"), F.lit("too short").alias("note")))


@query("ui_sorted", f"{SQL_CORE}, s AS (SELECT key, CASE WHEN key < 'F' THEN NULL ELSE sharpe END AS v FROM card) SELECT key, v, (row_number() OVER (ORDER BY v ASC NULLS LAST, key))::INTEGER AS up, (row_number() OVER (ORDER BY v DESC NULLS LAST, key))::INTEGER AS down FROM s")
def ui_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """Either way, what has no value comes last."""
    s = rounded(M.core(record(spark, sf))).select("key", F.when(F.col("key") >= "F", F.col("sharpe")).alias("v"))
    w = lambda c: F.row_number().over(Window.orderBy(c, "key"))  # noqa: E731  a board: one row per result
    return s.select("key", "v", w(F.asc_nulls_last("v")).alias("up"), w(F.desc_nulls_last("v")).alias("down"))


_JUDGE = f"""WITH {SQL_RECORD}, own_s AS (SELECT key, round({_SHARPE}, 6) AS own FROM record GROUP BY 1),
  x AS (SELECT *, floor((row_number() OVER (PARTITION BY key ORDER BY day) - 1) / 730) AS era FROM record), w AS (SELECT key, era, {_SHARPE} AS s FROM x GROUP BY 1, 2 HAVING count(*) >= 365),
  rho AS (SELECT key, CASE WHEN count(*) >= 3 THEN greatest(least(0.5 * avg((s > 0)::INT) + 0.3 * greatest(least(1 - stddev_samp(s) / 2, 1), 0) + 0.2 / (1 + exp(-min(s))), 1), 0) END AS rho FROM w GROUP BY key),
  y AS (SELECT key, year(day) AS y, exp(sum(ln(1 + r))) - 1 AS gain, count(*) AS n, sum(ln(1 + r)) AS l FROM record GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY gain DESC, y) AS nth FROM y),
  yr AS (SELECT key, exp(sum(l) * (365 / 12) / sum(n)) - 1 AS month, CASE WHEN sum(n) FILTER (nth > 1) >= 365 THEN exp(sum(l) FILTER (nth > 1) * (365 / 12) / sum(n) FILTER (nth > 1)) - 1 END AS rest FROM k GROUP BY key),
  dear AS (SELECT key, {_SHARPE.replace('r)', 'r - 0.0003)')} AS s, exp(sum(ln(1 + r - 0.0003)) * 365 / count(*)) - 1 AS cagr FROM record GROUP BY 1)"""


@query("judged_rules", f"""{_JUDGE}, j AS (SELECT key, 'eras' AS "check", round(rho, 6) AS worst, CASE WHEN rho IS NULL THEN 'too_short' WHEN rho >= 0.6 THEN 'passed' ELSE 'failed' END AS state FROM rho
  UNION ALL SELECT key, 'best_year', round(rest, 6), CASE WHEN rest IS NULL THEN 'too_short' WHEN rest >= 0.5 * month THEN 'passed' ELSE 'failed' END FROM yr UNION ALL SELECT key, 'costs', round(s, 6), CASE WHEN s > 0 AND cagr > 0 THEN 'passed' ELSE 'failed' END FROM dear
  UNION ALL SELECT key, c, NULL, 'not_measured' FROM own_s, (SELECT unnest(['luck', 'vs_hold', 'timing', 'pbo', 'plateau', 'delay', 'names', 'neighbour_lists', 'seeds', 'vs_rule']) AS c)) SELECT * FROM j""")
def judged_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(judged_of(spark, sf))


def judged_of(spark: SparkSession, sf: str) -> DataFrame:
    """The checks that a record alone can tell, by the board's rules."""
    rec = record(spark, sf)
    keyed = lambda df, check, **v: df.select("key", F.lit(check).alias("check"), F.explode(F.array(*(F.struct(F.lit(k).alias("figure"), c.cast("double").alias("value")) for k, c in v.items()))).alias("x")).select("key", "check", "x.figure", "x.value")
    dear = M.core(rec.withColumn("r", F.col("r") - 0.0003))
    measured = keyed(S.consistency(rec), "eras", rho=F.col("rho")).unionByName(keyed(M.best_year(rec), "best_year", avg_monthly=F.col("avg_monthly"), rest=F.col("without"))).unionByName(keyed(dear, "costs", sharpe=F.col("sharpe"), cagr=F.col("cagr")))
    return robust.judged(measured, M.core(rec).select("key", "sharpe"), 2.0)


@query("board_judged", f"""{_JUDGE.replace('k AS (', 'ky AS (').replace('FROM k ', 'FROM ky ').replace(' y AS (', ' yy AS (').replace('FROM y)', 'FROM yy)')}, {SQL_CORE.split('WITH ', 1)[1].split(SQL_RECORD + ', ', 1)[1]}, j AS (SELECT key, (coalesce(rho >= 0.6, false))::INT AS ok, 1 AS n FROM rho UNION ALL SELECT key, coalesce(rest >= 0.5 * month, false)::INT, 1 FROM yr UNION ALL SELECT key, (s > 0 AND cagr > 0)::INT, 1 FROM dear), p AS (SELECT key, sum(ok)::BIGINT AS passed, sum(n)::BIGINT AS applicable FROM j GROUP BY 1),
  bo AS (SELECT key, cagr, sharpe, (avg_monthly >= 0.015)::INT + (coalesce(green_active, 0) >= 0.7)::INT + (max_dd >= -0.1)::INT + (sharpe >= 1)::INT AS targets_met FROM card)
  SELECT (row_number() OVER (ORDER BY cagr > 0 DESC, passed DESC, targets_met DESC, sharpe DESC, key))::INTEGER AS place, key, cagr, sharpe, targets_met, passed, applicable FROM bo JOIN p USING (key)""")
def board_judged(spark: SparkSession, sf: str) -> DataFrame:
    """The board with its checks: money makers first, then by checks passed, targets met and ratio."""
    card = M.targets(rounded(M.core(record(spark, sf))).withColumn("beats_hold", F.lit(False)))
    return robust.board(judged_of(spark, sf), card)


@query("research_meta", f"{SQL_CORE} SELECT {len(STRATEGIES)}::BIGINT AS strategies, count(*) AS results, sum((days < 2400)::INT)::BIGINT AS too_short, sum((cagr > 0)::INT)::BIGINT AS earning, {len(robust.CHECKS)}::BIGINT AS checks FROM card")
def research_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Counts that head the research page."""
    card = rounded(M.core(record(spark, sf)))
    return card.agg(F.lit(len(STRATEGIES)).cast("long").alias("strategies"), F.count(F.lit(1)).alias("results"), F.count_if(F.col("days") < 2400).alias("too_short"), F.count_if(F.col("cagr") > 0).alias("earning"), F.lit(len(robust.CHECKS)).cast("long").alias("checks"))


_TGT = f"ab AS (SELECT *, coalesce((close > avg(close) OVER {_frame(20)})::INT, 0) AS above FROM bars), tg AS (SELECT instrument, ts, close, coalesce(lag(above) {W}, 0) AS h, coalesce(close / lag(close) {W} - 1, 0) AS r FROM ab)"


@query("research_assets", f"WITH {V.SQL_NATION}, {_TGT}, d AS (SELECT instrument, h * r * 0.02 AS r FROM tg) SELECT 'above_average' AS strategy, instrument, '1d' AS timeframe, count(*) AS bars, round({_SHARPE}, 6) AS sharpe, round(sum((r > 0)::INT) / nullif(sum((r <> 0)::INT), 0), 6) AS won FROM d GROUP BY instrument")
def research_assets(spark: SparkSession, sf: str) -> DataFrame:
    """A row per strategy, instrument and timeframe."""
    b = V.bars_nation(spark, sf).withColumn("above", F.coalesce((F.col("close") > F.avg("close").over(I.rows(20))).cast("int"), F.lit(0)))
    d = b.withColumn("h", F.coalesce(F.lag("above").over(P.own()), F.lit(0))).withColumn("r", F.col("h") * F.coalesce(F.col("close") / F.lag("close").over(P.own()) - 1, F.lit(0.0)) * 0.02)
    g = d.groupBy("instrument").agg(F.count(F.lit(1)).alias("bars"), r6(M.ratio(F.avg("r"), F.stddev_samp("r")) * F.lit(365**0.5)).alias("sharpe"), r6(F.count_if(F.col("r") > 0) / F.nullif(F.count_if(F.col("r") != 0), F.lit(0))).alias("won"))
    return g.select(F.lit("above_average").alias("strategy"), "instrument", F.lit("1d").alias("timeframe"), "bars", "sharpe", "won")


@query("research_result", f"""{SQL_CONFIGS}, t AS (SELECT fold, config, count(*) AS d, count(*) FILTER (r <> 0) AS n, sum(r) AS s1, sum(r * r) AS s2 FROM folds JOIN configs ON day < test_start GROUP BY 1, 2), q AS (SELECT fold, config, round(coalesce(s1 / d / nullif(sqrt(greatest((s2 - s1 * s1 / d) / (d - 1), 0)), 0), 0) * sqrt(365), 9) AS sharpe FROM t WHERE n >= 60),
  chosen AS (SELECT fold, arg_max(config, (sharpe, -config)) AS config, max(sharpe) AS sharpe FROM q GROUP BY fold)
  SELECT f.fold, f.test_start, f.test_end, c.config, round(c.sharpe, 6) AS trained, round(exp(sum(ln(1 + greatest(x.r, -0.999999)))) - 1, 8) AS gain, count(x.r) AS days FROM folds f JOIN chosen c USING (fold) JOIN configs x ON x.config = c.config AND x.day >= f.test_start AND x.day < f.test_end GROUP BY ALL""")
def research_result(spark: SparkSession, sf: str) -> DataFrame:
    """A result's windows: what each chose, on what, and what it made."""
    rec = config_records(spark, sf)
    fold = S.folds(rec)
    c = fold.join(S.choose(rec, fold), "fold").join(rec, "config").where((F.col("day") >= F.col("test_start")) & (F.col("day") < F.col("test_end")))
    return c.groupBy("fold", "test_start", "test_end", "config", r6("sharpe").alias("trained")).agg(F.round(M.grown("r") - 1, 8).alias("gain"), F.count("r").alias("days"))


@query("exposure_daily_gross", f"WITH {V.SQL_REGION}, {_SIDE}, g AS (SELECT ts, sum(abs(side)) / 5.0 AS gross FROM sd GROUP BY 1), dd AS (SELECT unnest(generate_series((SELECT min(ts) FROM g), (SELECT max(ts) FROM g), INTERVAL 1 DAY)) AS day) SELECT day, round(last_value(gross IGNORE NULLS) OVER (ORDER BY day), 6) AS gross FROM dd LEFT JOIN g ON g.ts = day")
def daily_gross(spark: SparkSession, sf: str) -> DataFrame:
    """Gross exposure of every calendar day; a day without bars holds what the day before did."""
    g = sided(spark, sf).groupBy(F.col("ts").alias("day")).agg((F.sum(F.abs("side")) / 5.0).alias("gross")).withColumn("key", F.lit("book"))
    span = g.groupBy("key").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    days = span.select("key", F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("day")).join(g, ["key", "day"], "left")
    return days.select("day", r6(F.last("gross", ignorenulls=True).over(M.own())).alias("gross"))
