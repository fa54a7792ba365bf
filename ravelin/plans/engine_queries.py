"""Queries on the engine: segments, fills, costs, walks, seats and slots, ledgers, luck and portfolios."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.functions import indicators as I
from ravelin.functions import recursion as X
from ravelin.functions.recursion import atr_of
from ravelin.operators import luck as L
from ravelin.operators import metrics as M
from ravelin.operators import panel as P
from ravelin.operators import states as S
from ravelin.operators import walks as K
from ravelin.operators.intrabar import exits_inside
from ravelin.operators.sums import exact_sum
from ravelin.plans.bar_queries import PANEL
from ravelin.plans.record_queries import FASTS, GRID, SLOWS, SQL_RECORD, config_records, record, rounded
from ravelin.plans.registry import query
from ravelin.plans.signal_queries import _frame, r6
from ravelin.sources import views as V

W = "OVER (PARTITION BY instrument ORDER BY ts)"
PREV = "OVER (PARTITION BY instrument ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
R = f"WITH {V.SQL_REGION}, {PANEL}"


def before() -> Window:
    return P.own().rowsBetween(Window.unboundedPreceding, -1)


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return P.aligned(V.bars_region(spark, sf))


def targeted(spark: SparkSession, sf: str, fast: int = 10, slow: int = 50) -> DataFrame:
    """The panel with the target of a cross of averages, shared alike by five names; a missed bar keeps its target."""
    b = V.bars_region(spark, sf)
    side = F.coalesce(I.cross(I.sma("close", fast), I.sma("close", slow)), F.lit(0.0))
    own = b.withColumn("target", side / 5)
    return P.grid(b).join(own, ["instrument", "ts"], "left").withColumn("target", F.coalesce(F.last("target", ignorenulls=True).over(P.own()), F.lit(0.0)))


_TGT = f"""own AS (SELECT *, coalesce(sign(CASE WHEN count(close) OVER {_frame(50)} = 50 THEN avg(close) OVER {_frame(10)} - avg(close) OVER {_frame(50)} END), 0)::DOUBLE / 5 AS t FROM bars),
  tgt AS (SELECT g.instrument, g.ts, o.open, o.close, coalesce(last_value(t IGNORE NULLS) {W}, 0) AS target FROM grid g LEFT JOIN own o USING (instrument, ts))"""


@query("segment_returns", f"{R}, s AS (SELECT *, last_value(close IGNORE NULLS) {PREV} AS b FROM panel) SELECT instrument, ts, round(coalesce(open / b - 1, 0), 6) AS gap, round(coalesce(close / open - 1, 0), 6) AS session, round(coalesce(close / b - 1, 0), 6) AS total FROM s")
def segment_returns(spark: SparkSession, sf: str) -> DataFrame:
    s = panel(spark, sf).withColumn("b", F.last("close", ignorenulls=True).over(before()))
    zero = lambda c: r6(F.coalesce(c, F.lit(0.0)))
    return s.select("instrument", "ts", zero(F.col("open") / F.col("b") - 1).alias("gap"), zero(F.col("close") / F.col("open") - 1).alias("session"), zero(F.col("close") / F.col("b") - 1).alias("total"))


@query("fills_next_open", f"{R}, {_TGT}, l AS (SELECT *, lag(target) {W} AS lt FROM tgt) SELECT instrument, ts, round(coalesce(last_value(CASE WHEN open IS NOT NULL THEN lt END IGNORE NULLS) {W}, 0), 6) AS filled FROM l")
def fills_open(spark: SparkSession, sf: str) -> DataFrame:
    t = targeted(spark, sf).withColumn("_lt", F.lag("target").over(P.own()))
    return t.select("instrument", "ts", r6(F.coalesce(F.last(F.when(F.col("open").isNotNull(), F.col("_lt")), ignorenulls=True).over(P.own()), F.lit(0.0))).alias("filled"))


@query("fills_next_close", f"{R}, {_TGT}, l AS (SELECT *, lag(target) {W} AS lt FROM tgt), f AS (SELECT *, coalesce(last_value(CASE WHEN open IS NOT NULL THEN lt END IGNORE NULLS) {W}, 0) AS x FROM l) SELECT instrument, ts, round(coalesce(lag(x) {W}, 0), 6) AS held FROM f")
def fills_close(spark: SparkSession, sf: str) -> DataFrame:
    t = targeted(spark, sf).withColumn("_lt", F.lag("target").over(P.own()))
    t = t.withColumn("x", F.coalesce(F.last(F.when(F.col("open").isNotNull(), F.col("_lt")), ignorenulls=True).over(P.own()), F.lit(0.0)))
    return t.select("instrument", "ts", r6(F.coalesce(F.lag("x").over(P.own()), F.lit(0.0))).alias("held"))


#: Commission and half spread in basis points, yearly borrow in basis points, by asset class.
CLASSES = [("perp", 5.0, 1.0, 0.0), ("spot", 10.0, 1.0, 293.0), ("equity", 1.0, 2.0, 50.0), ("fx", 0.0, 1.0, 0.0), ("commodity", 0.0, 2.0, 0.0)]
_CLASSES = ", ".join(f"('{a}', {c}, {s}, {b})" for a, c, s, b in CLASSES)


@query("cost_rates", f"SELECT r_name AS instrument, k.class AS class, round((c + s) / 1e4, 8)::DOUBLE AS rate, round(b / 1e4, 8)::DOUBLE AS borrow FROM region JOIN (VALUES {_CLASSES}) k(class, c, s, b) ON k.class = (['perp', 'spot', 'equity', 'fx', 'commodity'])[r_regionkey + 1]")
def cost_rates(spark: SparkSession, sf: str) -> DataFrame:
    k = spark.createDataFrame(CLASSES, "class string, c double, s double, b double")
    r = V.table(spark, sf, "region").withColumn("class", F.element_at(F.array(*(F.lit(c[0]) for c in CLASSES)), F.col("r_regionkey") + 1))
    return r.join(F.broadcast(k), "class").select(F.col("r_name").alias("instrument"), "class", F.round((F.col("c") + F.col("s")) / 1e4, 8).alias("rate"), F.round(F.col("b") / 1e4, 8).alias("borrow"))


@query("exact_sums", "SELECT event_type AS kind, (event_id % 97)::INTEGER AS k, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def exact_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of values among others that cancel out, sixteen digits greater: what plain sums lose."""
    v = F.col("value")
    t = V.table(spark, sf, "events").select(F.col("event_type").alias("kind"), (F.col("event_id") % 97).cast("int").alias("k"), F.explode(F.array(v, v * 1e16, -v * 1e16, -v / 3, v / 3)).alias("x"))
    return exact_sum(t, ["kind", "k"], "x").withColumn("total", r6("total"))


@query("account_walk")
def account_walk(spark: SparkSession, sf: str) -> DataFrame:
    book = targeted(spark, sf).withColumn("book", F.lit("sma_cross")).select("book", "ts", "instrument", "open", "high", "close", "target")
    return rounded(K.run_account(book, "book", K.Costs(0.0005, 0.005)))


@query("account_walk_grid")
def account_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Books of the whole grid, each an own group: bars and averages are made once, and rows fan out to the books last."""
    b = V.bars_region(spark, sf).select("instrument", "ts", "open", "high", "close", *(I.sma("close", n).alias(f"s{n}") for n in FASTS + SLOWS))
    each = [F.struct(F.lit(f"{f}/{s}").alias("book"), (F.coalesce(I.cross(f"s{f}", f"s{s}"), F.lit(0.0)) / 5).alias("target")) for _, f, s in GRID]
    books = b.select("ts", "instrument", "open", "high", "close", F.explode(F.array(*each)).alias("x")).select("x.book", "ts", "instrument", "open", "high", "close", "x.target")
    a = K.run_account(books, "book", K.Costs(0.0005, 0.005))
    return rounded(a.groupBy("book").agg(F.count(F.lit(1)).alias("bars"), (M.grown("net") - 1).alias("gain"), F.sum("cost").alias("cost"), F.max("exposure").alias("exposure")))


def _exit_pass(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("ts", kind="stable").reset_index(drop=True)
    o, h, lo, c = (pdf[x].to_numpy(float) for x in ("open", "high", "low", "close"))
    px, held = K.exits(o, h, lo, pdf["side"].to_numpy(float), K.Exits(stop=0.05, take=0.1, trail_atr=3.0), atr_of(h, lo, c, 14))
    return pdf[["instrument", "ts"]].assign(exit_px=px, held=held)


@query("exit_walk")
def exit_walk(spark: SparkSession, sf: str) -> DataFrame:
    b = V.bars_region(spark, sf).withColumn("side", F.coalesce(I.cross(I.sma("close", 5), I.sma("close", 20)), F.lit(0.0)))
    out = b.groupBy("instrument").applyInPandas(_exit_pass, "instrument string, ts timestamp, exit_px double, held double")
    return out.select("instrument", "ts", r6(F.when(~F.isnan("exit_px"), F.col("exit_px"))).alias("exit_px"), "held")


_STEP = "OVER (PARTITION BY instrument ORDER BY ts)"
_INSIDE = f"""WITH {V.sql_event()}, minutes AS ({{minutes}}),
  s AS (SELECT *, coalesce(sign(CASE WHEN count(close) OVER {_frame(20)} = 20 THEN avg(close) OVER {_frame(5)} - avg(close) OVER {_frame(20)} END), 0)::DOUBLE AS side FROM bars),
  d AS (SELECT instrument, ts, open, lag(side) {_STEP} AS want FROM s), c AS (SELECT *, CASE WHEN want IS DISTINCT FROM lag(want) {_STEP} THEN 1 ELSE 0 END AS turned FROM d),
  i AS (SELECT *, sum(turned) {_STEP} AS island FROM c), e AS (SELECT *, first_value(open) OVER (PARTITION BY instrument, island ORDER BY ts) AS entry FROM i WHERE want <> 0),
  tried AS (
    SELECT e.instrument, e.island, e.ts, m.ts AS tick_ts, CASE
      WHEN want > 0 AND low <= entry * 0.95 THEN least(m.open, entry * 0.95) WHEN want < 0 AND high >= entry * 1.05 THEN greatest(m.open, entry * 1.05)
      WHEN want > 0 AND high >= entry * 1.1 THEN greatest(m.open, entry * 1.1) WHEN want < 0 AND low <= entry * 0.9 THEN least(m.open, entry * 0.9) END AS px
    FROM e JOIN minutes AS m ON m.instrument = e.instrument AND m.bar = e.ts),
  x AS (SELECT instrument, island, min(tick_ts) AS tick_ts, arg_min(px, tick_ts) AS px, arg_min(ts, tick_ts) AS ts FROM tried WHERE px IS NOT NULL GROUP BY 1, 2)
  SELECT e.instrument, e.ts, round(CASE WHEN x.ts = e.ts THEN x.px END, 6) AS exit_px, CASE WHEN x.ts = e.ts THEN x.tick_ts - INTERVAL 1 MINUTE END AS exit_at, e.want AS held
  FROM e LEFT JOIN x USING (instrument, island) WHERE x.ts IS NULL OR e.ts <= x.ts"""
_MINUTES = f"SELECT *, time_bucket(INTERVAL '1 hour', ts - INTERVAL 1 MICROSECOND, TIMESTAMP '1970-01-01') + INTERVAL 1 HOUR AS bar FROM (WITH {V.sql_event('1 minute')} SELECT * FROM bars)"
_ON_BARS = "SELECT *, ts AS bar FROM bars"


def _hours(spark: SparkSession, sf: str, variants: int) -> DataFrame:
    """Hourly bars with the side of a cross of averages for each variant, and the ATR."""
    b = V.bars_event(spark, sf)
    side = F.coalesce(I.cross(I.sma("close", 5), I.sma("close", 20)), F.lit(0.0))
    b = X.recursive(b.select("instrument", "ts", "open", "high", "low", "close"), atr=("atr", 14))
    return b.withColumn("sides", F.array_repeat(side, variants))


def _left(out: DataFrame) -> DataFrame:
    return out.select("instrument", "ts", r6("exit_px").alias("exit_px"), "exit_at", "held")


@query("exits_inside_bars", _INSIDE.replace("{minutes}", _MINUTES))
def exits_by_minutes(spark: SparkSession, sf: str) -> DataFrame:
    """Stops and takes of hourly positions where the minutes inside the bars reach them first."""
    return _left(exits_inside(_hours(spark, sf, 1), V.bars_event(spark, sf, "1 minute"), [K.Exits(stop=0.05, take=0.1)], ["bar"]))


@query("exits_on_bars", _INSIDE.replace("{minutes}", _ON_BARS).replace("x.tick_ts - INTERVAL 1 MINUTE", "NULL::TIMESTAMP"))
def exits_by_bars(spark: SparkSession, sf: str) -> DataFrame:
    """The same exits where no minutes are stored: by the bars' own prices."""
    return _left(exits_inside(_hours(spark, sf, 1), None, [K.Exits(stop=0.05, take=0.1)], ["bar"]))


@query("trail_every_minute")
def trail_every(spark: SparkSession, sf: str) -> DataFrame:
    """A trailing stop of an ATR set anew each bar and each minute: exits of either."""
    rules = [K.Exits(trail_atr=2.0)] * 2
    out = exits_inside(_hours(spark, sf, 2), V.bars_event(spark, sf, "1 minute"), rules, ["bar", "minute"])
    name = F.element_at(F.array(F.lit("bar"), F.lit("minute")), F.col("variant") + 1).alias("trail_every")
    return out.where("exit_px IS NOT NULL").select("instrument", "ts", name, r6("exit_px").alias("exit_px"), "exit_at", "held")


@query("books_inside_bars")
def books_inside(spark: SparkSession, sf: str) -> DataFrame:
    """The whole grid of a breakout with a trailing stop on hours with their minutes: each configuration's account."""
    from ravelin.plans import strategies as T
    from ravelin.plans.evaluate import books_of
    from ravelin.operators import books as B

    bars, s = V.bars_event(spark, sf), T.STRATEGIES["breakout_trail"]
    configs = s.configs(5)
    books = books_of(bars, s, configs, minutes=V.bars_event(spark, sf, "1 minute"))
    a = B.run_books(books, s.kind, configs, K.Costs(0.0005, 0.005, 1 / (365 * 24)))
    names = spark.createDataFrame([(i, str(c["n_in"]), str(c["trail_atr"]), c["trail_every"], str(c["slots"]), c["long_only"]) for i, c in enumerate(configs)], "config int, n_in string, trail_atr string, trail_every string, slots string, long_only boolean")
    return rounded(a.groupBy("config").agg((M.grown("net") - 1).alias("gain"), F.sum("turnover").alias("turnover")).join(F.broadcast(names), "config"))


_QUOTED = f"""{R.replace("WITH ", "WITH RECURSIVE ", 1)}, {_TGT}, x AS (
    SELECT dense_rank() OVER (ORDER BY ts) - 1 AS t, tgt.instrument, ts, tgt.open AS o, tgt.close AS c, greatest(target, 0) AS g,
      CASE WHEN day(ts) % 3 = 0 THEN round((b.high - b.low) / b.close * 0.001, 8) END AS q
    FROM tgt LEFT JOIN bars AS b USING (instrument, ts)),
  n AS (
    SELECT *, last_value(c IGNORE NULLS) {PREV} AS k, lag(g) {W} AS was, last_value(CASE WHEN q IS NOT NULL THEN t END IGNORE NULLS) {W} AS t0,
      first_value(CASE WHEN q IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1 FROM x),
  rated AS (SELECT n.*, coalesce(y.q, 0.0005) AS rate FROM n LEFT JOIN x AS y ON y.instrument = n.instrument AND y.t = CASE WHEN t1 IS NULL OR n.t - t0 <= t1 - n.t THEN t0 ELSE t1 END),
  rows_ AS (
    SELECT t, any_value(ts) AS ts, list(CASE WHEN o IS NOT NULL AND c IS NOT NULL AND k IS NOT NULL THEN o / k - 1 END ORDER BY instrument) AS gap, list(c / o - 1 ORDER BY instrument) AS r,
      list(was ORDER BY instrument) AS g, list(rate ORDER BY instrument) AS q, list(o IS NOT NULL AND c IS NOT NULL AND k IS NOT NULL ORDER BY instrument) AS ok FROM rated GROUP BY t),
  walk AS (
    SELECT 0::BIGINT AS t, list_transform(ok, lambda z: 0.0::DOUBLE) AS w, list_transform(ok, lambda z: 0.0::DOUBLE) AS done, 0.0::DOUBLE AS net, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS turnover, 0.0::DOUBLE AS exposure
    FROM rows_ WHERE t = 0
    UNION ALL
    SELECT t, list_transform(range(1, len(w) + 1), lambda i: want[i] * (1 + r0[i]) / (1 + session)), done, grow * (1 - cost) * (1 + session) - 1, cost, turnover, exposure FROM (
      SELECT *, list_sum(list_transform(range(1, len(w) + 1), lambda i: want[i] * r0[i])) AS session, list_sum(list_transform(range(1, len(w) + 1), lambda i: abs(want[i] - pre[i]) * q[i])) AS cost,
        list_sum(list_transform(range(1, len(w) + 1), lambda i: abs(want[i] - pre[i]))) AS turnover, list_sum(want) AS exposure FROM (
        SELECT *, list_transform(range(1, len(w) + 1), lambda i: CASE WHEN asked[i] > pre[i] AND kept + added > 1 THEN pre[i] + (asked[i] - pre[i]) * greatest(1 - kept, 0) / added ELSE asked[i] END) AS want FROM (
          SELECT *, list_sum(list_transform(range(1, len(w) + 1), lambda i: least(asked[i], pre[i]))) AS kept, list_sum(list_transform(range(1, len(w) + 1), lambda i: greatest(asked[i] - pre[i], 0))) AS added FROM (
            SELECT * EXCLUDE (done), list_transform(range(1, len(w) + 1), lambda i: CASE WHEN ok[i] AND g[i] <> done[i] THEN g[i] ELSE pre[i] END) AS asked,
              list_transform(range(1, len(w) + 1), lambda i: CASE WHEN ok[i] AND g[i] <> done[i] THEN g[i] ELSE done[i] END) AS done, list_transform(range(1, len(w) + 1), lambda i: CASE WHEN ok[i] THEN r[i] ELSE 0 END) AS r0 FROM (
              SELECT *, list_transform(range(1, len(w) + 1), lambda i: w[i] * (1 + coalesce(gap[i], 0)) / grow) AS pre FROM (
                SELECT rows_.t, w, done, gap, r, g, q, ok, 1 + list_sum(list_transform(range(1, len(w) + 1), lambda i: w[i] * coalesce(gap[i], 0))) AS grow FROM walk JOIN rows_ ON rows_.t = walk.t + 1))))))
  )
  SELECT rows_.ts, round(net, 8) + 0.0 AS net, round(cost, 8) + 0.0 AS cost, round(turnover, 6) + 0.0 AS turnover, round(exposure, 6) + 0.0 AS exposure FROM walk JOIN rows_ USING (t)"""


@query("account_quoted", _QUOTED)
def account_quoted(spark: SparkSession, sf: str) -> DataFrame:
    """The account of a long book whose fills pay quoted rates: on days without a quote the nearest one of the name."""
    quotes = V.bars_region(spark, sf).where(F.dayofmonth("ts") % 3 == 0).select("instrument", "ts", F.round((F.col("high") - F.col("low")) / F.col("close") * 0.001, 8).alias("quoted"))
    book = targeted(spark, sf).withColumn("target", F.greatest("target", F.lit(0.0))).join(quotes, ["instrument", "ts"], "left").withColumn("book", F.lit("long"))
    a = K.run_account(book.select("book", "ts", "instrument", "open", "high", "close", "target", "quoted"), "book", K.Costs(0.0005))
    plain = lambda c, digits: (F.round(c, digits) + F.lit(0.0)).alias(c)  # noqa: E731  # no negative zeros
    return a.select("ts", plain("net", 8), plain("cost", 8), plain("turnover", 6), plain("exposure", 6))


def _hold_pass(pdf: pd.DataFrame) -> pd.DataFrame:
    ts, _, (o, c, member) = K.matrix(pdf, "open", "close", "member")
    return pd.DataFrame({"book": pdf["book"].iloc[0], "ts": ts, "net": K.hold(o, c, np.nan_to_num(member) > 0, 0.0005)})


@query("hold_walk")
def hold_walk(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf).withColumn("book", F.lit("all")).withColumn("member", (F.count("close").over(P.own()) > 0).cast("double"))
    return rounded(p.select("book", "instrument", "ts", "open", "close", "member").groupBy("book").applyInPandas(_hold_pass, "book string, ts timestamp, net double"))


@query("left_list_exits", f"""{R}, m AS (SELECT instrument, ts, close, dollar_volume > avg(dollar_volume) OVER (PARTITION BY ts) AS member FROM bars), l AS (SELECT *, lag(member) {W} AS was FROM m)
  SELECT instrument, ts, round(close, 6) AS close FROM l WHERE was AND NOT member""")
def left_list(spark: SparkSession, sf: str) -> DataFrame:
    m = V.bars_region(spark, sf).withColumn("member", F.col("dollar_volume") > F.avg("dollar_volume").over(Window.partitionBy("ts")))
    return m.withColumn("was", F.lag("member").over(P.own())).where("was AND NOT member").select("instrument", "ts", r6("close").alias("close"))


def _seat_pass(pdf: pd.DataFrame) -> pd.DataFrame:
    ts, names, (listed, side, money) = K.matrix(pdf, "listed", "side", "money")
    out = K.seats(np.nan_to_num(listed) > 0, np.nan_to_num(side), money)
    t, j = np.nonzero(out)
    return pd.DataFrame({"ts": ts[t], "instrument": names[j]})


@query("seats")
def seats(spark: SparkSession, sf: str) -> DataFrame:
    """Who sits among the three names most traded in the month before; books are groups."""
    b = V.bars_region(spark, sf)
    month = b.groupBy("instrument", F.trunc("ts", "MM").alias("m")).agg(F.sum("dollar_volume").alias("money"))
    rank = F.row_number().over(Window.partitionBy("m").orderBy(F.desc("money"), "instrument"))
    listed = month.withColumn("listed", (rank <= 3).cast("double")).withColumn("m", F.add_months("m", 1))  # known when the month begins
    side = F.coalesce(I.cross(I.sma("close", 5), I.sma("close", 20)), F.lit(0.0))
    x = b.select("instrument", "ts", F.trunc("ts", "MM").alias("m"), side.alias("side")).join(listed, ["instrument", "m"]).withColumn("book", F.lit("top3"))
    return x.groupBy("book").applyInPandas(_seat_pass, "ts timestamp, instrument string")


def _slot_pass(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["start", "instrument"], kind="stable").reset_index(drop=True)
    taken = K.slots(pdf["start"].astype("int64").to_numpy(), pdf["end"].astype("int64").to_numpy(), pdf["money"].to_numpy(float), pdf["instrument"].rank(method="dense").to_numpy(), 5)
    return pdf.assign(taken=taken)[["instrument", "side", "start", "end", "taken"]]


@query("slots")
def slots(spark: SparkSession, sf: str) -> DataFrame:
    b = V.bars_brand(spark, sf).withColumn("w", F.avg("close").over(I.rows(5)) - F.avg("close").over(I.rows(20)))
    money = b.select("instrument", F.col("ts").alias("start"), F.avg("dollar_volume").over(P.own().rowsBetween(-20, -1)).alias("money"))  # of the bars before a trade
    t = S.spans(b, "w").join(money, ["instrument", "start"], "left").fillna(0.0, ["money"]).withColumn("book", F.substring("instrument", 1, 7))  # a list per maker; its trades, not its bars
    return t.groupBy("book").applyInPandas(_slot_pass, "instrument string, side int, start timestamp, end timestamp, taken boolean")


def _buffer_pass(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.rename(columns={"month": "ts"})
    ts, names, (rank, money) = K.matrix(pdf, "rank", "money")
    out = K.buffered_top(np.where(np.isnan(rank), 1e9, rank), np.nan_to_num(money) > 0, 3)
    t, j = np.nonzero(out)
    return pd.DataFrame({"month": ts[t], "instrument": names[j]})


@query("topn_buffered")
def topn_buffered(spark: SparkSession, sf: str) -> DataFrame:
    m = V.bars_brand(spark, sf).groupBy("instrument", F.date_trunc("month", "ts").alias("month")).agg(F.expr("percentile(dollar_volume, 0.5D)").alias("money"))
    m = m.withColumn("book", F.substring("instrument", 1, 7))  # a list per maker, the three most traded names of each
    m = m.withColumn("rank", F.row_number().over(Window.partitionBy("book", "month").orderBy(F.desc("money"), "instrument")).cast("double"))
    return m.groupBy("book").applyInPandas(_buffer_pass, "month timestamp, instrument string")


@query("trade_ledger", f"""{R}, {_TGT}, l AS (SELECT *, lag(target) {W} AS lt FROM tgt), f AS (SELECT *, coalesce(last_value(CASE WHEN open IS NOT NULL THEN lt END IGNORE NULLS) {W}, 0) AS x FROM l),
  s AS (SELECT *, sign(x)::INTEGER AS side FROM f), c AS (SELECT *, CASE WHEN side IS DISTINCT FROM lag(side) {W} THEN 1 ELSE 0 END AS ch FROM s), i AS (SELECT *, sum(ch) {W} AS island FROM c),
  nx AS (SELECT *, lead(open) {W} AS no, max(ts) OVER (PARTITION BY instrument) AS last_ts FROM i),
  t AS (SELECT instrument, side, min(ts) AS entry_time, max(ts) AS exit_time, count(*) AS bars, arg_min(open, ts) AS entry_px, arg_max(close, ts) FILTER (close IS NOT NULL) AS last_close, max(last_ts) AS last_ts FROM nx WHERE side <> 0 GROUP BY instrument, side, island)
  SELECT instrument, side, entry_time, exit_time, bars, round(entry_px, 6) AS entry_px, round(last_close, 6) AS exit_px, round(side * (last_close / entry_px - 1), 6) AS gross_return,
    round(side * (last_close / entry_px - 1) - 0.001, 6) AS net_return, CASE WHEN exit_time = last_ts THEN 'open_at_end' ELSE 'signal' END AS exit_reason FROM t""")
def trade_ledger(spark: SparkSession, sf: str) -> DataFrame:
    t = targeted(spark, sf).withColumn("_lt", F.lag("target").over(P.own()))
    t = t.withColumn("x", F.coalesce(F.last(F.when(F.col("open").isNotNull(), F.col("_lt")), ignorenulls=True).over(P.own()), F.lit(0.0))).withColumn("side", F.signum("x").cast("int"))
    i = P.runs_of(t, "side").withColumn("last_ts", F.max("ts").over(Window.partitionBy("instrument"))).where("side <> 0")
    g = i.groupBy("instrument", "side", "island").agg(
        F.min("ts").alias("entry_time"), F.max("ts").alias("exit_time"), F.count(F.lit(1)).alias("bars"), F.min_by("open", "ts").alias("entry_px"),
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("ts"))).alias("exit_px"), F.max("last_ts").alias("last_ts"),
    )
    gross = F.col("side") * (F.col("exit_px") / F.col("entry_px") - 1)
    return g.select(
        "instrument", "side", "entry_time", "exit_time", "bars", r6("entry_px").alias("entry_px"), r6("exit_px").alias("exit_px"), r6(gross).alias("gross_return"), r6(gross - 0.001).alias("net_return"),
        F.when(F.col("exit_time") == F.col("last_ts"), "open_at_end").otherwise("signal").alias("exit_reason"),
    )


@query("cost_stress", f"{R}, {_TGT}, l AS (SELECT *, coalesce(lag(target) {W}, 0) AS x, coalesce(lag(target, 2) {W}, 0) AS px, coalesce(close / last_value(close IGNORE NULLS) {PREV} - 1, 0) AS r FROM tgt), d AS (SELECT ts, sum(x * r) AS gross, sum(abs(x - px)) * 0.0005 AS cost FROM l GROUP BY ts) SELECT m.m AS multiple, round(avg((1 + gross) * (1 - m.m * cost) - 1), 8) AS mean, count(*) AS bars FROM d, (VALUES (1), (3), (5)) m(m) GROUP BY 1")
def cost_stress(spark: SparkSession, sf: str) -> DataFrame:
    t = targeted(spark, sf)
    b = F.last("close", ignorenulls=True).over(before())
    t = t.select("ts", F.coalesce(F.lag("target").over(P.own()), F.lit(0.0)).alias("x"), F.coalesce(F.lag("target", 2).over(P.own()), F.lit(0.0)).alias("px"), F.coalesce(F.col("close") / b - 1, F.lit(0.0)).alias("r"))
    d = t.groupBy("ts").agg(F.sum(F.col("x") * F.col("r")).alias("gross"), (F.sum(F.abs(F.col("x") - F.col("px"))) * 0.0005).alias("cost"))
    m = d.withColumn("multiple", F.explode(F.array(*map(F.lit, (1, 3, 5)))))
    return m.groupBy("multiple").agg(F.round(F.avg((1 + F.col("gross")) * (1 - F.col("multiple") * F.col("cost")) - 1), 8).alias("mean"), F.count(F.lit(1)).alias("bars"))


@query("delay_one_bar")
def delay(spark: SparkSession, sf: str) -> DataFrame:
    t = targeted(spark, sf)
    late = t.withColumn("target", F.coalesce(F.lag("target").over(P.own()), F.lit(0.0))).withColumn("book", F.lit("delayed"))
    both = t.withColumn("book", F.lit("as decided")).unionByName(late).select("book", "ts", "instrument", "open", "high", "close", "target")
    return rounded(K.run_account(both, "book", K.Costs()).groupBy("book").agg((M.grown("net") - 1).alias("gain"), F.avg("net").alias("mean")))


@query("exposure_stats", f"{R}, {_TGT}, d AS (SELECT ts, sum(abs(target)) AS e FROM tgt GROUP BY ts) SELECT round(avg((e > 0)::INT), 6) AS share_of_days, round(avg(e), 6) AS mean_exposure FROM d")
def exposure_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = targeted(spark, sf).groupBy("ts").agg(F.sum(F.abs("target")).alias("e"))
    return rounded(d.agg(F.avg((F.col("e") > 0).cast("double")).alias("share_of_days"), F.avg("e").alias("mean_exposure")))


@query("daily_position", f"{R}, {_TGT} SELECT instrument, date_trunc('week', ts)::TIMESTAMP AS week, round(arg_max(target, ts), 6) AS position FROM tgt GROUP BY 1, 2")
def daily_position(spark: SparkSession, sf: str) -> DataFrame:
    return targeted(spark, sf).groupBy("instrument", F.date_trunc("week", "ts").alias("week")).agg(r6(F.max_by("target", "ts")).alias("position"))


# Luck.


@query("monte_carlo")
def monte_carlo(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.monte_carlo(record(spark, sf)))


@query("random_timing")
def random_timing(spark: SparkSession, sf: str) -> DataFrame:
    """The cross of averages on all names as one book, and on each name alone, against 500 turned timings of each."""
    known = F.last("close", ignorenulls=True).over(before())
    t = targeted(spark, sf).select(
        F.lit("book").alias("key"), "instrument", "ts", F.coalesce(F.lag("target").over(P.own()), F.lit(0.0)).alias("weight"), (F.col("open") / known - 1).alias("gap"),
        (F.col("close") / F.col("open") - 1).alias("session"), F.lit(0.0).alias("funding"), F.col("close").isNotNull().cast("double").alias("member"),
    )
    return rounded(L.random_timing(t.unionByName(t.withColumn("key", F.col("instrument")))))


@query("paired_t")
def paired_t(spark: SparkSession, sf: str) -> DataFrame:
    c = config_records(spark, sf)
    a, b = c.where("config = 4").select("day", F.col("r").alias("a")), c.where("config <> 4").select(F.col("config").cast("string").alias("key"), "day", F.col("r").alias("b"))
    return rounded(L.paired(b.join(a, "day")))


@query("deflated_sharpe")
def deflated(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.deflated(record(spark, sf), 100))


@query("pair_scores", f"WITH {SQL_RECORD}, n AS (SELECT key, count(*) AS n FROM record GROUP BY 1), c AS (SELECT x.key AS a, y.key AS b, corr(x.r, y.r) AS rho, count(*) AS s FROM record x JOIN record y ON x.day = y.day AND x.key < y.key GROUP BY 1, 2) SELECT a, b, round(CASE WHEN s < 60 THEN 0 ELSE coalesce(rho, 0) * s / sqrt(na.n * nb.n) END, 6)::DOUBLE AS score FROM c JOIN n na ON na.key = a JOIN n nb ON nb.key = b")
def pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.pair_scores(record(spark, sf)))


@query("luck_of")
def luck(spark: SparkSession, sf: str) -> DataFrame:
    """Tries of each region's records and of all: as how many independent ones they count, and the best that luck gives one time in twenty."""
    nation, region = V.table(spark, sf, "nation"), V.table(spark, sf, "region")
    of = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("key"), F.col("r_name").alias("family"))
    return rounded(L.luck_of(record(spark, sf).join(of, "key")))


@query("at_target_dd")
def at_target(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.at_target_drawdown(record(spark, sf)))


# Portfolio and forward plan.

_PORT = f"""WITH {SQL_RECORD}, v AS (SELECT key, day, r, stddev_samp(r) OVER w AS sd, count(r) OVER w AS n FROM record WINDOW w AS (PARTITION BY key ORDER BY day ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING)),
  f AS (SELECT key, day, 1 / nullif(sd, 0) AS inv FROM v WHERE n >= 90 AND day = date_trunc('month', day)), w AS (SELECT key, day AS month, inv / sum(inv) OVER (PARTITION BY day) AS weight FROM f)"""


@query("portfolio_weights", f"{_PORT} SELECT key, month::TIMESTAMP AS month, round(weight, 6) AS weight FROM w")
def portfolio_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_weights(record(spark, sf)))


def _weights(rec: DataFrame) -> DataFrame:
    """Inverse-deviation weights at each month's first day from the 90 days before it."""
    w = M.own().rowsBetween(-90, -1)
    v = rec.withColumn("sd", F.stddev_samp("r").over(w)).withColumn("n", F.count("r").over(w))
    f = v.where((F.col("n") >= 90) & (F.col("day") == F.date_trunc("month", "day"))).withColumn("inv", 1 / F.nullif("sd", F.lit(0.0)))
    return f.select("key", F.col("day").alias("month"), (F.col("inv") / F.sum("inv").over(Window.partitionBy("day"))).alias("weight"))


@query("portfolio_returns", f"""{_PORT}, g AS (SELECT key, day, month, weight * exp(sum(ln(1 + r)) OVER (PARTITION BY key, month ORDER BY day)) AS v FROM record JOIN w USING (key) WHERE date_trunc('month', day) = month),
  s AS (SELECT day, month, sum(v) AS v FROM g GROUP BY 1, 2) SELECT day, round(v / coalesce(lag(v) OVER (PARTITION BY month ORDER BY day), 1) - 1, 8) AS r FROM s""")
def portfolio_returns(spark: SparkSession, sf: str) -> DataFrame:
    rec = record(spark, sf).withColumn("month", F.date_trunc("month", "day"))
    w = Window.partitionBy("key", "month").orderBy("day")
    g = rec.join(_weights(record(spark, sf)), ["key", "month"]).withColumn("v", F.col("weight") * F.exp(F.sum(F.log1p("r")).over(w)))
    s = g.groupBy("day", "month").agg(F.sum("v").alias("v"))
    return s.select("day", F.round(F.col("v") / F.coalesce(F.lag("v").over(Window.partitionBy("month").orderBy("day")), F.lit(1.0)) - 1, 8).alias("r"))


@query("forward_orders", f"""{R}, {_TGT}, k AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts DESC) AS n FROM tgt)
  SELECT a.instrument, a.ts AS bar, round(b.target, 6) AS held, round(a.target, 6) AS wanted, CASE WHEN sign(a.target) = sign(b.target) THEN 'keep' WHEN a.target = 0 THEN 'close' WHEN b.target = 0 THEN 'open' ELSE 'flip' END AS "order" FROM k a JOIN k b ON b.instrument = a.instrument AND a.n = 1 AND b.n = 30""")
def forward_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that turn the sides saved 29 bars ago into today's."""
    n = F.row_number().over(Window.partitionBy("instrument").orderBy(F.desc("ts")))
    k = targeted(spark, sf).withColumn("n", n).where("n IN (1, 30)").groupBy("instrument").agg(
        F.max("ts").alias("bar"), r6(F.max(F.when(F.col("n") == 30, F.col("target")))).alias("held"), r6(F.max(F.when(F.col("n") == 1, F.col("target")))).alias("wanted")
    )
    order = F.when(F.signum("wanted") == F.signum("held"), "keep").when(F.col("wanted") == 0, "close").when(F.col("held") == 0, "open").otherwise("flip")
    return k.select("instrument", "bar", "held", "wanted", order.alias("order"))
