"""Queries on indicators, states, time joins and cross-sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.functions import indicators as I
from ravelin.functions import recursion as X
from ravelin.operators import joins as J
from ravelin.operators import panel as P
from ravelin.operators import states as S
from ravelin.plans.registry import query
from ravelin.sources import views as V

W = "PARTITION BY instrument ORDER BY ts"
R = f"WITH {V.SQL_REGION}"


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def _bars(spark: SparkSession, sf: str) -> DataFrame:
    return V.bars_region(spark, sf)


def _frame(n: int, to: int = 0) -> str:
    return f"({W} ROWS BETWEEN {n - 1 + to} PRECEDING AND {f'{to} PRECEDING' if to else 'CURRENT ROW'})"


def _full(expr: str, counted: str, n: int, to: int = 0) -> str:
    return f"CASE WHEN count({counted}) OVER {_frame(n, to)} = {n} THEN {expr} END"


def _one(name: str, sql: str, **columns) -> None:
    """A query of indicator columns over daily bars."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _bars(spark, sf).select("instrument", "ts", *(r6(c()).alias(n) for n, c in columns.items()))

    query(name, sql)(run)


_one("ind_sma", f"{R} SELECT instrument, ts, round({_full(f'avg(close) OVER {_frame(20)}', 'close', 20)}, 6) AS sma FROM bars", sma=lambda: I.sma("close", 20))
_b = f"avg(close) OVER {_frame(20)}"
_d = f"stddev_pop(close) OVER {_frame(20)}"
_bands = {n: (lambda i=i: I.bollinger("close", 20, 2.0)[i]) for i, n in enumerate(("lower", "middle", "upper"))}
_one("ind_bbands", f"{R} SELECT instrument, ts, round({_full(f'{_b} - 2 * {_d}', 'close', 20)}, 6) AS lower, round({_full(_b, 'close', 20)}, 6) AS middle, round({_full(f'{_b} + 2 * {_d}', 'close', 20)}, 6) AS upper FROM bars", **_bands)
_one("ind_donchian", f"{R} SELECT instrument, ts, round({_full(f'max(high) OVER {_frame(20, 1)}', 'high', 20, 1)}, 6) AS channel_high, round({_full(f'min(low) OVER {_frame(20, 1)}', 'low', 20, 1)}, 6) AS channel_low FROM bars", channel_high=lambda: I.donchian(20)[0], channel_low=lambda: I.donchian(20)[1])
_one("ind_ibs", f"{R} SELECT instrument, ts, round((close - low) / nullif(high - low, 0), 6) AS ibs FROM bars", ibs=lambda: I.ibs())
_one("ind_roc", f"{R} SELECT instrument, ts, round(close / lag(close, 10) OVER ({W}) - 1, 6) AS roc FROM bars", roc=lambda: I.roc("close", 10))
_TR = f"CASE WHEN lag(close) OVER ({W}) IS NULL THEN high - low ELSE greatest(high, lag(close) OVER ({W})) - least(low, lag(close) OVER ({W})) END"
_one("ind_true_range", f"{R} SELECT instrument, ts, round({_TR}, 6) AS tr FROM bars", tr=lambda: I.true_range())
_n14 = f"min(low) OVER {_frame(14)}"
_x14 = f"max(high) OVER {_frame(14)}"
_one("ind_willr", f"{R} SELECT instrument, ts, round({_full(f'CASE WHEN {_x14} = {_n14} THEN 0 ELSE -100 * ({_x14} - close) / ({_x14} - {_n14}) END', 'close', 14)}, 6) AS willr FROM bars", willr=lambda: I.williams_r(14))
_one("label_forward", f"{R} SELECT instrument, ts, round(lead(close, 5) OVER ({W}), 6) AS then FROM bars", then=lambda: F.lead("close", 5).over(I.own()))

_RET = f"ret AS (SELECT *, ln(close / lag(close) OVER ({W})) AS r FROM bars)"


def returns(spark: SparkSession, sf: str) -> DataFrame:
    return _bars(spark, sf).withColumn("r", I.log_return())


@query("ind_realized_vol", f"{R}, {_RET} SELECT instrument, ts, round({_full(f'stddev_samp(r) OVER {_frame(20)}', 'r', 20)}, 6) AS vol FROM ret")
def realized_vol(spark: SparkSession, sf: str) -> DataFrame:
    return returns(spark, sf).select("instrument", "ts", r6(I.realized_vol("r", 20)).alias("vol"))


@query("ind_obv", f"{R}, s AS (SELECT *, CASE WHEN lag(close) OVER ({W}) IS NULL THEN volume ELSE sign(close - lag(close) OVER ({W})) * volume END AS v FROM bars) SELECT instrument, ts, round(sum(v) OVER ({W}), 6) AS obv FROM s")
def obv(spark: SparkSession, sf: str) -> DataFrame:
    return _bars(spark, sf).withColumn("v", I.obv()).select("instrument", "ts", r6(F.sum("v").over(I.own())).alias("obv"))


_lo5, _hi5 = f"min(low) OVER {_frame(5)}", f"max(high) OVER {_frame(5)}"
_k5 = f"CASE WHEN {_hi5} = {_lo5} THEN 0 ELSE 100 * (close - {_lo5}) / ({_hi5} - {_lo5}) END"


@query("ind_stoch", f"{R}, f AS (SELECT *, {_full(_k5, 'close', 5)} AS k FROM bars), s AS (SELECT *, {_full(f'avg(k) OVER {_frame(3)}', 'k', 3)} AS sk FROM f) SELECT instrument, ts, round(sk, 6) AS slow_k, round({_full(f'avg(sk) OVER {_frame(3)}', 'sk', 3)}, 6) AS slow_d FROM s")
def stoch(spark: SparkSession, sf: str) -> DataFrame:
    return I.stochastic(5, 3, 3)(_bars(spark, sf)).select("instrument", "ts", r6("slow_k").alias("slow_k"), r6("slow_d").alias("slow_d"))


@query("ind_mfi", f"""{R}, t AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), m AS (SELECT *, tp - lag(tp) OVER ({W}) AS mv, tp * volume AS fl FROM t),
  u AS (SELECT *, CASE WHEN mv > 0 THEN fl WHEN mv IS NOT NULL THEN 0 END AS up, CASE WHEN mv < 0 THEN fl WHEN mv IS NOT NULL THEN 0 END AS dn FROM m),
  s AS (SELECT *, sum(up) OVER {_frame(14)} AS su, sum(dn) OVER {_frame(14)} AS sd, count(up) OVER {_frame(14)} AS c FROM u)
  SELECT instrument, ts, round(CASE WHEN c = 14 THEN CASE WHEN su + sd < 1 THEN 0 ELSE 100 * su / (su + sd) END END, 6) AS mfi FROM s""")
def mfi(spark: SparkSession, sf: str) -> DataFrame:
    return I.money_flow(14)(_bars(spark, sf)).select("instrument", "ts", r6("mfi").alias("mfi"))


_NUM = "n AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts) AS rn FROM bars)"


def smoothed(source: str, x: str, n: int, first: int, step: str, name: str = "e") -> str:
    """A recursive CTE (instrument, rn, v): the mean of x over n rows from row `first`, then step, in which @ is the CTE."""
    last = first + n - 1
    return f"""{name} AS (SELECT instrument, {last}::BIGINT AS rn, avg({x}) AS v FROM {source} WHERE rn BETWEEN {first} AND {last} GROUP BY instrument HAVING count(*) = {n}
    UNION ALL SELECT s.instrument, s.rn, {step.replace("@", name)} FROM {name} JOIN {source} AS s ON s.instrument = {name}.instrument AND s.rn = {name}.rn + 1)"""


def ema_sql(n: int, name: str = "e", source: str = "n", x: str = "close", first: int = 1) -> str:
    return smoothed(source, x, n, first, f"@.v + (s.{x} - @.v) * 2.0 / ({n} + 1)", name)


def wilder_sql(source: str, x: str, n: int, name: str = "e", first: int = 2) -> str:
    return smoothed(source, x, n, first, f"(@.v * {n - 1} + s.{x}) / {n}", name)


def rsi_sql(n: int) -> str:
    """CTEs up to rsi(instrument, rn, rsi)."""
    return f"""rm AS (SELECT *, close - lag(close) OVER ({W}) AS d FROM n), rt AS (SELECT *, greatest(d, 0) AS u, greatest(-d, 0) AS w FROM rm),
  {wilder_sql("rt", "u", n, "ru")}, {wilder_sql("rt", "w", n, "rw")},
  rsi AS (SELECT instrument, rn, CASE WHEN ru.v + rw.v = 0 THEN 0 ELSE 100 * ru.v / (ru.v + rw.v) END AS rsi FROM ru JOIN rw USING (instrument, rn))"""


def adx_sql(n: int) -> str:
    """CTEs up to adx(instrument, rn, v)."""
    return f"""am AS (SELECT *, high - lag(high) OVER ({W}) AS up, lag(low) OVER ({W}) - low AS dn FROM n),
  ad AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pl, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mi FROM am),
  ax AS (SELECT instrument, {n}::BIGINT AS rn, sum(pl) AS p, sum(mi) AS q FROM ad WHERE rn BETWEEN 2 AND {n} GROUP BY instrument HAVING count(*) = {n - 1}
    UNION ALL SELECT s.instrument, s.rn, ax.p - ax.p / {n} + s.pl, ax.q - ax.q / {n} + s.mi FROM ax JOIN ad AS s ON s.instrument = ax.instrument AND s.rn = ax.rn + 1),
  dx AS (SELECT instrument, rn, CASE WHEN p + q > 0 THEN 100 * abs(p - q) / (p + q) ELSE 0 END AS dx FROM ax WHERE rn > {n}),
  {wilder_sql("dx", "dx", n, "adx", n + 1)}"""


_RR = R.replace("WITH", "WITH RECURSIVE")


@query("ind_ema", f"{_RR}, {_NUM}, {ema_sql(20)} SELECT instrument, ts, round(v, 6) AS ema FROM n LEFT JOIN e USING (instrument, rn)")
def ema(spark: SparkSession, sf: str) -> DataFrame:
    return X.recursive(_bars(spark, sf), ema=("ema", 20)).select("instrument", "ts", r6("ema").alias("ema"))


@query("ind_atr", f"{_RR}, {_NUM}, t AS (SELECT *, {_TR} AS tr FROM n), {wilder_sql('t', 'tr', 14)} SELECT instrument, ts, round(v, 6) AS atr FROM n LEFT JOIN e USING (instrument, rn)")
def atr(spark: SparkSession, sf: str) -> DataFrame:
    return X.recursive(_bars(spark, sf), atr=("atr", 14)).select("instrument", "ts", r6("atr").alias("atr"))


@query("ind_rsi", f"{_RR}, {_NUM}, {rsi_sql(14)} SELECT instrument, ts, round(rsi, 6) AS rsi FROM n LEFT JOIN rsi USING (instrument, rn)")
def rsi(spark: SparkSession, sf: str) -> DataFrame:
    return X.recursive(_bars(spark, sf), rsi=("rsi", 14)).select("instrument", "ts", r6("rsi").alias("rsi"))


@query("ind_adx", f"{_RR}, {_NUM}, {adx_sql(14)} SELECT instrument, ts, round(v, 6) AS adx FROM n LEFT JOIN adx USING (instrument, rn)")
def adx(spark: SparkSession, sf: str) -> DataFrame:
    return X.recursive(_bars(spark, sf), adx=("adx", 14)).select("instrument", "ts", r6("adx").alias("adx"))


@query("ind_macd", f"""{_RR}, {_NUM}, {ema_sql(12, "f", first=15)}, {ema_sql(26, "g")}, l AS (SELECT instrument, rn, f.v - g.v AS line FROM f JOIN g USING (instrument, rn)), {ema_sql(9, "h", "l", "line", 26)}
  SELECT instrument, ts, round(CASE WHEN h.v IS NOT NULL THEN line END, 6) AS macd, round(h.v, 6) AS macd_signal, round(line - h.v, 6) AS macd_hist FROM n LEFT JOIN l USING (instrument, rn) LEFT JOIN h USING (instrument, rn)""")
def macd(spark: SparkSession, sf: str) -> DataFrame:
    return X.recursive(_bars(spark, sf), macd=("macd", 12, 26, 9)).select("instrument", "ts", *(r6(c).alias(c) for c in ("macd", "macd_signal", "macd_hist")))


_W10 = " + ".join(f"lag(close, {i}) OVER ({W}) * {10 - i}" for i in range(1, 10))


@query("ind_by_name", f"""{R}, n AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts) AS rn, (high + low + close) / 3 AS tp FROM bars), a AS (SELECT *, {_full(f'avg(tp) OVER {_frame(20)}', 'tp', 20)} AS m, array_agg(tp) OVER {_frame(20)} AS l,
    count(*) OVER {_frame(15)} AS c15, arg_max(rn, (high, rn)) OVER {_frame(15)} AS hi, arg_max(rn, (-low, rn)) OVER {_frame(15)} AS lo FROM n)
  SELECT instrument, ts, round(close - lag(close, 10) OVER ({W}), 6) AS mom, round(({_W10} + close * 10) / 55, 6) AS wma, round(CASE WHEN m IS NOT NULL THEN coalesce((tp - m) / (0.015 * nullif(list_sum(list_transform(l, lambda x: abs(x - m))) / 20, 0)), 0) END, 4) AS cci,
    round(CASE WHEN c15 = 15 THEN 100.0 * (14 - (rn - hi)) / 14 END, 6)::DOUBLE AS aroon_up, round(CASE WHEN c15 = 15 THEN 100.0 * (14 - (rn - lo)) / 14 END, 6)::DOUBLE AS aroon_down, round({_full(f'regr_slope(close, rn) OVER {_frame(14)}', 'close', 14)}, 6) AS linearreg_slope,
    round({_full(f'stddev_pop(close) OVER {_frame(10)}', 'close', 10)}, 6) AS stddev, round({_full(f'(max(close) OVER {_frame(10)} + min(close) OVER {_frame(10)}) / 2', 'close', 10)}, 6) AS midpoint FROM a""")
def by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Indicators called by their names."""
    b = _bars(spark, sf)
    for name, n in (("mom", 10), ("wma", 10), ("cci", 20), ("aroon", 14), ("linearreg_slope", 14), ("stddev", 10), ("midpoint", 10)):
        b = I.call(b, name, n)
    return b.select("instrument", "ts", *(r6(c).alias(c) for c in ("mom", "wma", "aroon_up", "aroon_down", "linearreg_slope", "stddev", "midpoint")), F.round("cci", 4).alias("cci"))


# States.

_IBS = "CASE WHEN (close - low) / nullif(high - low, 0) < 0.2 THEN 1.0 WHEN (close - low) / nullif(high - low, 0) > 0.8 THEN 0.0 END"


@query("hold_between", f"{R}, s AS (SELECT *, {_IBS} AS e FROM bars) SELECT instrument, ts, coalesce(last_value(e IGNORE NULLS) OVER ({W}), 0)::DOUBLE AS position FROM s")
def hold_between(spark: SparkSession, sf: str) -> DataFrame:
    return _bars(spark, sf).withColumn("ibs", I.ibs()).select("instrument", "ts", S.hold_between(F.col("ibs") < 0.2, F.col("ibs") > 0.8).alias("position"))


_UP = f"u AS (SELECT *, close > avg(close) OVER {_frame(20)} AS side FROM bars)"
_RUNS = f"c AS (SELECT *, CASE WHEN side IS DISTINCT FROM lag(side) OVER ({W}) THEN 1 ELSE 0 END AS ch FROM u), i AS (SELECT *, sum(ch) OVER ({W}) AS island FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY instrument, island ORDER BY ts) AS nth FROM i)"


def sides(spark: SparkSession, sf: str) -> DataFrame:
    return _bars(spark, sf).withColumn("side", F.col("close") > F.avg("close").over(I.rows(20)))


@query("confirmed_state", f"{R}, {_UP}, {_RUNS} SELECT instrument, ts, last_value(CASE WHEN nth >= 3 THEN side END IGNORE NULLS) OVER ({W}) AS confirmed FROM k")
def confirmed(spark: SparkSession, sf: str) -> DataFrame:
    return S.confirmed(sides(spark, sf), "side", 3).select("instrument", "ts", "confirmed")


@query("after_runs", f"{R}, {_UP}, {_RUNS} SELECT instrument, ts, coalesce(last_value(CASE WHEN side AND nth >= 3 THEN 1.0 WHEN NOT side AND nth >= 2 THEN 0.0 END IGNORE NULLS) OVER ({W}), 0)::DOUBLE AS position FROM k")
def after_runs(spark: SparkSession, sf: str) -> DataFrame:
    return S.after_runs(sides(spark, sf), "side", 3, 2).select("instrument", "ts", "position")


@query("age_of_side", f"{R}, {_UP}, {_RUNS} SELECT instrument, ts, side, nth::INTEGER AS age FROM k")
def age_of_side(spark: SparkSession, sf: str) -> DataFrame:
    return S.age(sides(spark, sf), "side").select("instrument", "ts", "side", "age")


@query("vol_state", f"""{R}, {_RET}, v AS (SELECT *, round({_full(f'stddev_samp(r) OVER {_frame(20)}', 'r', 20)}, 9) AS v FROM ret),
  l AS (SELECT *, array_agg(v) FILTER (v IS NOT NULL) OVER {_frame(250)} AS l FROM v),
  k AS (SELECT *, len(l) AS n, (len(list_filter(l, lambda x: x < v)) + (len(list_filter(l, lambda x: x = v)) + 1) / 2) / len(l) AS rank FROM l)
  SELECT instrument, ts, CASE WHEN v IS NOT NULL AND n >= 125 THEN CASE WHEN rank <= 1.0::DOUBLE / 3 THEN 0 WHEN rank <= 2.0::DOUBLE / 3 THEN 1 ELSE 2 END END::INTEGER AS state FROM k""")
def vol_state(spark: SparkSession, sf: str) -> DataFrame:
    v = returns(spark, sf).withColumn("v", F.round(I.realized_vol("r", 20), 9))
    return v.select("instrument", "ts", S.vol_state("v", 250, 125).alias("state"))


@query("trend_state", f"""{_RR}, {_NUM}, {adx_sql(14)}, {ema_sql(50)}, j AS (SELECT n.*, adx.v AS a, e.v - lag(e.v) OVER (PARTITION BY n.instrument ORDER BY ts) AS d FROM n LEFT JOIN adx USING (instrument, rn) LEFT JOIN e USING (instrument, rn))
  SELECT instrument, ts, CASE WHEN a IS NULL OR d IS NULL THEN NULL WHEN a > 25 THEN sign(d) ELSE 0 END::INTEGER AS state FROM j""")
def trend_state(spark: SparkSession, sf: str) -> DataFrame:
    b = X.recursive(_bars(spark, sf), adx=("adx", 14), ema=("ema", 50))
    slope = F.signum(F.col("ema") - F.lag("ema").over(I.own()))
    return b.select("instrument", "ts", F.when(F.col("adx").isNull() | slope.isNull(), None).when(F.col("adx") > 25, slope).otherwise(0.0).cast("int").alias("state"))


@query("regime_switch", f"{R}, {_UP}, {_RUNS}, f AS (SELECT *, last_value(CASE WHEN nth >= 3 THEN side END IGNORE NULLS) OVER ({W}) AS st FROM k) SELECT instrument, ts, (CASE WHEN st THEN 1.0 WHEN NOT st THEN -0.5 ELSE 0 END)::DOUBLE AS position FROM f")
def regime_switch(spark: SparkSession, sf: str) -> DataFrame:
    c = S.confirmed(sides(spark, sf), "side", 3)
    return c.select("instrument", "ts", F.when(F.col("confirmed"), 1.0).when(~F.col("confirmed"), -0.5).otherwise(0.0).alias("position"))


@query("rebalanced_weights", f"{R}, w AS (SELECT *, close / avg(close) OVER {_frame(50)} - 1 AS w, date_trunc('month', ts) IS DISTINCT FROM lag(date_trunc('month', ts)) OVER ({W}) AS st FROM bars) SELECT instrument, ts, round(coalesce(last_value(CASE WHEN st THEN coalesce(w, 0) END IGNORE NULLS) OVER ({W}), 0), 6) AS weight FROM w")
def rebalanced(spark: SparkSession, sf: str) -> DataFrame:
    w = _bars(spark, sf).withColumn("w", F.col("close") / F.avg("close").over(I.rows(50)) - 1).withColumn("st", P.period_start(F.col("ts"), "M"))
    return w.select("instrument", "ts", r6(S.rebalanced("w", F.col("st"))).alias("weight"))


@query("trade_spans", f"""{R}, w AS (SELECT *, sign(avg(close) OVER {_frame(10)} - avg(close) OVER {_frame(50)})::INTEGER AS side FROM bars), u AS (SELECT * FROM w),
  {_RUNS} SELECT instrument, side, min(ts) AS start, max(ts) AS "end", count(*) AS bars FROM i WHERE side <> 0 GROUP BY instrument, island, side""")
def trade_spans(spark: SparkSession, sf: str) -> DataFrame:
    return S.spans(_bars(spark, sf).withColumn("w", F.avg("close").over(I.rows(10)) - F.avg("close").over(I.rows(50))), "w")


# Joins in time.


@query("asof_months", f"""{R} SELECT b.instrument, b.ts, round(b.close / p.close - 1, 6) AS change FROM (SELECT *, ts - INTERVAL 6 MONTH AS t FROM bars) b
  ASOF LEFT JOIN bars p ON p.instrument = b.instrument AND p.ts <= b.t""")
def asof_months(spark: SparkSession, sf: str) -> DataFrame:
    return J.months_back(_bars(spark, sf), "instrument", "close", 6, "past").select("instrument", "ts", r6(F.col("close") / F.col("past") - 1).alias("change"))


_SETS = f"WITH {V.SQL_NATION}, {V.SQL_SETTLEMENTS}"


@query("asof_known_at", f"{_SETS} SELECT b.instrument, b.ts, s.settle AS value_ts, s.rate FROM bars b ASOF LEFT JOIN settlements s ON s.instrument = b.instrument AND s.settle <= b.ts")
def asof_known(spark: SparkSession, sf: str) -> DataFrame:
    bars = V.bars_nation(spark, sf).select("instrument", "ts")
    return J.as_of(bars, V.settlements(spark, sf), "instrument", "ts", "settle", ["rate"])


@query("asof_strictly_before", f"{_SETS} SELECT b.instrument, b.ts, s.settle AS value_ts, s.rate FROM bars b ASOF LEFT JOIN settlements s ON s.instrument = b.instrument AND s.settle < b.ts")
def asof_before(spark: SparkSession, sf: str) -> DataFrame:
    return J.as_of(V.bars_nation(spark, sf).select("instrument", "ts"), V.settlements(spark, sf), "instrument", "ts", "settle", ["rate"], strict=True)


@query("funding_trailing", f"WITH {V.SQL_SETTLEMENTS} SELECT instrument, settle, round(sum(rate) OVER (PARTITION BY instrument ORDER BY settle RANGE BETWEEN INTERVAL '29 days 23:59:59' PRECEDING AND CURRENT ROW), 12) AS trailing FROM settlements")
def funding_trailing(spark: SparkSession, sf: str) -> DataFrame:
    return V.settlements(spark, sf).select("instrument", "settle", F.round(J.trailing_sum("rate", "settle", 30), 12).alias("trailing"))


@query("funding_to_bars", f"""{_SETS}, m AS (SELECT s.instrument, s.rate, b.ts AS bar_ts FROM settlements s ASOF LEFT JOIN bars b ON b.instrument = s.instrument AND b.ts >= s.settle)
  SELECT instrument, bar_ts, count(*) AS settled, round(sum(rate), 12) AS rate FROM m WHERE bar_ts IS NOT NULL GROUP BY 1, 2""")
def funding_to_bars(spark: SparkSession, sf: str) -> DataFrame:
    m = J.next_bar(V.settlements(spark, sf), V.bars_nation(spark, sf), "instrument", "settle", ["rate"])
    return m.where("bar_ts IS NOT NULL").groupBy("instrument", "bar_ts").agg(F.count(F.lit(1)).alias("settled"), F.round(F.sum("rate"), 12).alias("rate"))


@query("dividends_to_bars", f"WITH {V.SQL_NATION}, {V.SQL_DIVIDENDS} SELECT d.instrument, d.ex_day, d.amount, b.ts AS bar_ts FROM dividends d ASOF LEFT JOIN bars b ON b.instrument = d.instrument AND b.ts >= d.ex_day")
def dividends_to_bars(spark: SparkSession, sf: str) -> DataFrame:
    return J.next_bar(V.dividends(spark, sf), V.bars_nation(spark, sf), "instrument", "ex_day", ["amount"])


@query("minutes_in_bars", f"""WITH {V.sql_event('1 minute').replace('bars AS', 'minutes AS')}, hours AS (SELECT instrument, time_bucket(INTERVAL '1 hour', ts - INTERVAL 1 MICROSECOND, TIMESTAMP '1970-01-01') + INTERVAL 1 HOUR AS ts, * EXCLUDE (instrument, ts) FROM minutes)
  SELECT instrument, ts, count(*) AS minutes, round(max(high), 6) AS high, round(min(low), 6) AS low FROM hours GROUP BY 1, 2""")
def minutes_in_bars(spark: SparkSession, sf: str) -> DataFrame:
    m = V.bars_event(spark, sf, "1 minute").withColumn("ts", F.window(F.col("ts") - F.expr("INTERVAL 1 MICROSECOND"), "1 hour").getField("end"))
    return m.groupBy("instrument", "ts").agg(F.count(F.lit(1)).alias("minutes"), r6(F.max("high")).alias("high"), r6(F.min("low")).alias("low"))


@query("spreads_per_bar", f"""WITH {V.sql_event('1 hour').replace('bars AS', 'hours AS')}, d AS (SELECT instrument, date_trunc('day', ts - INTERVAL 1 MICROSECOND) AS day, ts, high - low AS spread FROM hours)
  SELECT instrument, day, round(arg_min(spread, ts), 6) AS open, round(arg_max(spread, ts), 6) AS close, round(median(spread), 6) AS mid FROM d GROUP BY 1, 2""")
def spreads_per_bar(spark: SparkSession, sf: str) -> DataFrame:
    d = V.bars_event(spark, sf).select("instrument", F.date_trunc("day", F.col("ts") - F.expr("INTERVAL 1 MICROSECOND")).alias("day"), "ts", (F.col("high") - F.col("low")).alias("spread"))
    return d.groupBy("instrument", "day").agg(r6(F.min_by("spread", "ts")).alias("open"), r6(F.max_by("spread", "ts")).alias("close"), r6(F.expr("percentile(spread, 0.5D)")).alias("mid"))


@query("membership_spans", """WITH e AS (SELECT user_id, ts, event_id, event_type = 'signup' AS added FROM events WHERE event_type IN ('signup', 'error')),
  o AS (SELECT *, lag(added) OVER w AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), c AS (SELECT * FROM o WHERE coalesce(b <> added, added)),
  p AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS "end" FROM c) SELECT user_id, ts AS start, "end" FROM p WHERE added""")
def membership_spans(spark: SparkSession, sf: str) -> DataFrame:
    e = V.table(spark, sf, "events").where("event_type IN ('signup', 'error')").select("user_id", F.struct(F.col("ts").cast("timestamp").alias("ts"), "event_id").alias("at"), (F.col("event_type") == "signup").alias("added"))
    return J.spans_of_events(e, "user_id", "at", "added").select("user_id", F.col("start.ts").alias("start"), F.col("end.ts").alias("end"))


@query("member_mask", f"""{R}, e AS (SELECT instrument, ts, close > avg(close) OVER {_frame(20)} AS added FROM bars), o AS (SELECT *, lag(added) OVER ({W}) AS b FROM e),
  c AS (SELECT * FROM o WHERE coalesce(b <> added, added)), p AS (SELECT instrument, added, ts AS start, lead(ts) OVER ({W}) AS "end" FROM c), s AS (SELECT * FROM p WHERE added)
  SELECT b.instrument, b.ts, coalesce(s."end" IS NULL OR b.ts <= s."end", false) AND s.start IS NOT NULL AS member FROM bars b ASOF LEFT JOIN s ON s.instrument = b.instrument AND s.start <= b.ts""")
def member_mask(spark: SparkSession, sf: str) -> DataFrame:
    spans = J.spans_of_events(sides(spark, sf).select("instrument", "ts", "side"), "instrument", "ts", "side").withColumn("open", F.col("end").isNull())
    m = J.as_of(_bars(spark, sf).select("instrument", "ts"), spans, "instrument", "ts", "start", ["end", "open"])
    return m.select("instrument", "ts", (F.col("value_ts").isNotNull() & F.coalesce(F.col("open") | (F.col("ts") <= F.col("end")), F.lit(False))).alias("member"))


@query("tbill_trailing", """WITH days AS (SELECT unnest(generate_series(DATE '1995-01-01', DATE '1996-12-31', INTERVAL 1 DAY))::DATE AS day),
  q AS (SELECT o_orderdate::DATE AS day, avg(o_totalprice) / 3e6 AS pct FROM orders WHERE day(o_orderdate) % 7 = 1 GROUP BY 1), f AS (SELECT day, last_value(pct IGNORE NULLS) OVER (ORDER BY day) / 100 / 365 AS rate FROM days LEFT JOIN q USING (day)),
  g AS (SELECT day, rate, sum(ln(1 + rate)) OVER (ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS s FROM f) SELECT day::TIMESTAMP AS day, round(rate, 10) AS rate, round(exp(s) - 1, 8) AS trailing FROM g""")
def tbill_trailing(spark: SparkSession, sf: str) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.lit("1995-01-01").cast("date"), F.lit("1996-12-31").cast("date"))).alias("day"))
    quoted = V.table(spark, sf, "orders").where(F.dayofmonth("o_orderdate") % 7 == 1).groupBy(F.col("o_orderdate").cast("date").alias("day")).agg((F.avg("o_totalprice") / 3e6).alias("pct"))
    w = Window.orderBy("day")  # a calendar of days: a bounded table
    f = days.join(quoted, "day", "left").withColumn("rate", F.last("pct", ignorenulls=True).over(w) / 100 / 365)
    return f.select(F.col("day").cast("timestamp").alias("day"), F.round("rate", 10).alias("rate"), F.round(F.exp(F.sum(F.log1p("rate")).over(w.rowsBetween(-30, -1))) - 1, 8).alias("trailing"))


# Cross-sections.

_BRAND = f"WITH {V.SQL_BRAND}"


@query("liquidity_median", f"""WITH {V.SQL_REGION}, a AS (SELECT *, count(close) OVER ({W}) AS age, median(dollar_volume) OVER {_frame(60)} AS m FROM bars)
  SELECT instrument, ts, round(lag(CASE WHEN age >= 30 THEN m END) OVER ({W}), 4) AS liquidity FROM a""")
def liquidity(spark: SparkSession, sf: str) -> DataFrame:
    return S.liquidity(_bars(spark, sf), 60).select("instrument", "ts", F.round("liquidity", 4).alias("liquidity"))


@query("topn_monthly_rank", f"""{_BRAND}, m AS (SELECT instrument, date_trunc('month', ts)::TIMESTAMP AS month, round(median(dollar_volume), 4) AS money FROM bars GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY money DESC, instrument) AS rank FROM m) SELECT instrument, month, money, rank::INTEGER AS rank FROM r WHERE rank <= 10""")
def topn_monthly(spark: SparkSession, sf: str) -> DataFrame:
    m = V.bars_brand(spark, sf).groupBy("instrument", F.date_trunc("month", "ts").alias("month")).agg(F.round(F.expr("percentile(dollar_volume, 0.5D)"), 4).alias("money"))
    return m.withColumn("rank", F.row_number().over(Window.partitionBy("month").orderBy(F.desc("money"), "instrument"))).where("rank <= 10")


_MOM = f"mom AS (SELECT *, round(close / lag(close, 20) OVER ({W}) - 1, 9) AS score FROM bars)"
_ENDS = """ok AS (SELECT *, count(*) OVER (PARTITION BY ts) AS n FROM mom WHERE score IS NOT NULL), e AS (SELECT *, floor(least(greatest(floor(n * 0.2), 1), n / 2))::INTEGER AS k, row_number() OVER (PARTITION BY ts ORDER BY score, instrument) AS rank FROM ok),
  f AS (SELECT *, CASE WHEN rank <= k THEN -1 WHEN rank > n - k THEN 1 ELSE 0 END AS side FROM e)"""


def momentum(spark: SparkSession, sf: str) -> DataFrame:
    return V.bars_brand(spark, sf).withColumn("score", F.round(I.roc("close", 20), 9))


@query("ends_frac", f"{_BRAND}, {_MOM}, {_ENDS} SELECT instrument, ts, side FROM f")
def ends_frac(spark: SparkSession, sf: str) -> DataFrame:
    return S.ends(momentum(spark, sf), "score", 0.2).select("instrument", "ts", "side")


@query("long_short_weights", f"{_BRAND}, {_MOM}, {_ENDS} SELECT instrument, ts, round(CASE WHEN n < 6 OR side = 0 THEN 0 ELSE 0.5 * side / k END, 6)::DOUBLE AS weight FROM f")
def long_short_weights(spark: SparkSession, sf: str) -> DataFrame:
    return S.long_short(momentum(spark, sf), "score", 0.2).select("instrument", "ts", r6("weight").alias("weight"))


@query("xs_momentum_score", f"{_BRAND}, ret AS (SELECT *, ln(close / lag(close) OVER ({W})) AS r, close / lag(close, 60) OVER ({W}) - 1 AS m FROM bars) SELECT instrument, ts, round(m / nullif({_full(f'stddev_samp(r) OVER {_frame(60)}', 'r', 60)}, 0), 6) AS score FROM ret")
def xs_momentum_score(spark: SparkSession, sf: str) -> DataFrame:
    b = V.bars_brand(spark, sf).withColumn("r", I.log_return()).withColumn("m", I.roc("close", 60))
    return b.select("instrument", "ts", r6(F.col("m") / F.nullif(I.realized_vol("r", 60), F.lit(0.0))).alias("score"))


@query("rolling_beta", f"""{R}, {_RET}, x AS (SELECT *, avg(r) OVER (PARTITION BY ts) AS m FROM ret WHERE r IS NOT NULL)
  SELECT instrument, ts, round({_full(f'covar_samp(r, m) OVER {_frame(60)} / nullif(var_samp(m) OVER {_frame(60)}, 0)', 'r', 60)}, 6) AS beta FROM x""")
def rolling_beta(spark: SparkSession, sf: str) -> DataFrame:
    x = returns(spark, sf).where("r IS NOT NULL").withColumn("m", F.avg("r").over(Window.partitionBy("ts")))
    return x.select("instrument", "ts", r6(S.rolling_beta("r", "m", 60)).alias("beta"))


@query("dual_momentum_pick", f"{_BRAND}, {_MOM}, k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC NULLS LAST, instrument) AS rank FROM mom) SELECT instrument, ts, rank::INTEGER AS rank FROM k WHERE rank <= 3 AND score > 0.001")
def dual_momentum_pick(spark: SparkSession, sf: str) -> DataFrame:
    return S.top_k(momentum(spark, sf), "score", 3, F.lit(0.001)).where("weight > 0").select("instrument", "ts", "rank")


@query("sector_rotation_pick", f"{_BRAND}, {_MOM}, k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC NULLS LAST, instrument) AS rank FROM mom) SELECT instrument, ts, rank::INTEGER AS rank FROM k WHERE rank <= 3 AND score IS NOT NULL")
def sector_rotation_pick(spark: SparkSession, sf: str) -> DataFrame:
    return S.top_k(momentum(spark, sf), "score", 3).where("weight > 0").select("instrument", "ts", "rank")


@query("above_average_market", f"{R}, m AS (SELECT ts, avg(close) AS c FROM bars GROUP BY ts) SELECT ts, round(c / CASE WHEN count(c) OVER (ORDER BY ts ROWS 49 PRECEDING) = 50 THEN avg(c) OVER (ORDER BY ts ROWS 49 PRECEDING) END - 1, 6) AS above FROM m")
def above_average(spark: SparkSession, sf: str) -> DataFrame:
    m = _bars(spark, sf).groupBy("ts").agg(F.avg("close").alias("close")).withColumn("instrument", F.lit("market"))
    return m.select("ts", r6(F.col("close") / I.sma("close", 50) - 1).alias("above"))
