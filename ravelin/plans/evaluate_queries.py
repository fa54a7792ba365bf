"""Queries on whole evaluations, picks among strategies, calendars, features and identities."""

from __future__ import annotations

import hashlib
import inspect
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.functions import indicators as I
from ravelin.functions import recursion as X
from ravelin.operators import metrics as M
from ravelin.operators import panel as P
from ravelin.operators import selection as S
from ravelin.operators.joins import as_of
from ravelin.operators.panel import own
from ravelin.plans import strategies as T
from ravelin.plans.evaluate import evaluate, pick, walked_alone
from ravelin.plans.record_queries import SQL_CHOSEN, SQL_CONFIGS, rounded
from ravelin.plans.registry import query
from ravelin.plans.signal_queries import r6
from ravelin.sources import calendars
from ravelin.sources import views as V
from ravelin.sources.store import kept

W = "OVER (PARTITION BY instrument ORDER BY ts)"


def card_of(spark: SparkSession, sf: str, name: str, bars: DataFrame, **more) -> DataFrame:
    return rounded(evaluate(bars, T.STRATEGIES[name], **more).card)


@query("evaluate_sma_cross")
def evaluate_sma(spark: SparkSession, sf: str) -> DataFrame:
    """The whole grid: shares among the names that have begun."""
    return card_of(spark, sf, "sma_cross", V.bars_region(spark, sf))


@query("evaluate_xs_momentum")
def evaluate_xs(spark: SparkSession, sf: str) -> DataFrame:
    return card_of(spark, sf, "xs_momentum", V.bars_brand(spark, sf))


@query("evaluate_ibs_slots")
def evaluate_ibs(spark: SparkSession, sf: str) -> DataFrame:
    """The whole grid of a rule with slots, on monthly lists of the most traded names."""
    bars = kept(V.bars_brand(spark, sf), "bars")
    return card_of(spark, sf, "ibs", bars, member=top_members(bars, 10))


@query("evaluate_donchian_exits")
def evaluate_donchian(spark: SparkSession, sf: str) -> DataFrame:
    """The whole grid of a rule with stops within bars."""
    return card_of(spark, sf, "donchian_breakout", V.bars_region(spark, sf))


@query("evaluate_funding_carry")
def evaluate_funding(spark: SparkSession, sf: str) -> DataFrame:
    """A panel on what positions pay: settlements enter the ranking, and the account by the bar they fall into."""
    bars, paid = kept(V.bars_nation(spark, sf), "bars"), kept(V.settlements(spark, sf), "settlements")
    carry = interval_sum(paid, bars)
    return card_of(spark, sf, "funding_carry", bars, settlements=paid, carry=carry)


def interval_sum(settlements: DataFrame, bars: DataFrame) -> DataFrame:
    """(instrument, ts, funding, dividend): what settles within a bar."""
    from ravelin.operators.joins import next_bar

    at = next_bar(settlements.select("instrument", "settle", "rate"), bars.select("instrument", "ts"), "instrument", "settle", ["rate"])
    return at.groupBy("instrument", F.col("bar_ts").alias("ts")).agg(F.sum("rate").alias("funding")).withColumn("dividend", F.lit(0.0))


def top_members(bars: DataFrame, n: int) -> DataFrame:
    """(instrument, ts, listed): the n names that traded most in the month before."""
    month = bars.groupBy("instrument", F.date_trunc("month", "ts").alias("month")).agg(F.sum("dollar_volume").alias("money"))
    rank = F.row_number().over(Window.partitionBy("month").orderBy(F.desc("money"), "instrument"))
    listed = month.withColumn("rank", rank).select("instrument", (F.col("month") + F.expr("INTERVAL 1 MONTH")).alias("month"), (F.col("rank") <= n).alias("listed"))
    out = bars.select("instrument", "ts", F.date_trunc("month", "ts").alias("month")).join(listed, ["instrument", "month"], "left")
    return out.select("instrument", "ts", F.coalesce("listed", F.lit(False)).alias("listed"))


@query("robustness_sma_cross")
def robustness(spark: SparkSession, sf: str) -> DataFrame:
    """Every check of a walk-forward on a Top-10 list, judged."""
    from ravelin.plans import robust

    bars = kept(V.bars_brand(spark, sf), "bars")
    e = evaluate(bars, T.STRATEGIES["sma_cross"], member=top_members(bars, 10))
    lists = {n: kept(top_members(bars, n), "member") for n in robust.next_to(10)}
    tries, bar = robust.luck_bars(e)
    measured = robust.measure(e, tries, lists).withColumn("key", F.lit("sma_cross"))
    return rounded(robust.judged(measured, e.card.select("key", "sharpe"), bar))


@query("robustness_ibs_ml_filter")
def robustness_model(spark: SparkSession, sf: str) -> DataFrame:
    """The checks of a model's whole grid: other seeds, and the rule without it, among them."""
    from ravelin.plans import robust

    s = T.STRATEGIES["ibs_ml_filter"]
    e = evaluate(V.bars_region(spark, sf), s)
    tries, bar = robust.luck_bars(e)
    measured = robust.measure(e, tries, base=robust.base_of(s.name)).withColumn("key", F.lit(s.name))
    return rounded(robust.judged(measured, e.card.select("key", "sharpe"), bar))


CANDIDATES = ["sma_cross", "ema_trend", "ibs", "ibs_reversion", "rsi2_connors", "bollinger_reversion", "donchian_breakout", "keltner_breakout", "tsmom", "pocket_pivot"]


@query("evaluate_alone")
def evaluate_alone(spark: SparkSession, sf: str) -> DataFrame:
    """A rule on each instrument for itself, its grid walked forward: share of the best days, figures, targets."""
    own_ = walked_alone(kept(V.bars_region(spark, sf), "bars"), T.STRATEGIES["ibs"]).select("key", "day", "r")
    card = M.core(own_).withColumn("beats_hold", F.lit(False))
    return rounded(M.targets(card).join(M.best_days_share(own_), "key").select("key", "days", "sharpe", "cagr", "max_dd", "share", "targets_met"))


def picked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every candidate walked forward over its whole grid on each region, then chosen among by its record so far."""
    bars = kept(V.bars_region(spark, sf), "bars")
    walked = lambda n: walked_alone(bars, T.STRATEGIES[n])
    with ThreadPoolExecutor(4) as jobs:  # candidates know nothing of each other, and each is many short jobs
        each = [d.select("key", F.lit(i).alias("config"), "day", "r", "position") for i, d in enumerate(jobs.map(walked, CANDIDATES))]
    return pick(kept(reduce(DataFrame.unionByName, each), "records"))


@query("strategy_pick")
def strategy_pick(spark: SparkSession, sf: str) -> DataFrame:
    """Which strategy a walk-forward over candidates takes, per instrument and window."""
    return rounded(picked(spark, sf)[0])


@query("strategy_pick_record")
def strategy_pick_record(spark: SparkSession, sf: str) -> DataFrame:
    days = picked(spark, sf)[1]
    return rounded(days.groupBy("key").agg(F.count(F.lit(1)).alias("days"), (M.grown("r") - 1).alias("gain"), F.count_distinct("config").alias("strategies")))


_PEERS = """rec AS (SELECT instrument AS peer, config, ts AS day, held * r - abs(held - before) * 0.0002 AS r FROM h), hold AS (SELECT DISTINCT instrument AS peer, ts AS day, r FROM smas),
  rt AS (SELECT fold, peer, config, count(*) AS d, sum(rec.r) AS s1, sum(rec.r * rec.r) AS s2 FROM folds JOIN rec ON day < test_start GROUP BY 1, 2, 3), ht AS (SELECT fold, peer, count(*) AS d, sum(hold.r) AS s1, sum(hold.r * hold.r) AS s2 FROM folds JOIN hold ON day < test_start GROUP BY 1, 2),
  rq AS (SELECT fold, peer, config, CASE WHEN sqrt(greatest((s2 - s1 * s1 / d) / (d - 1), 0)) > 1e-15 THEN s1 / d / sqrt(greatest((s2 - s1 * s1 / d) / (d - 1), 0)) END AS own FROM rt),
  hq AS (SELECT fold, peer, CASE WHEN sqrt(greatest((s2 - s1 * s1 / d) / (d - 1), 0)) > 1e-15 THEN s1 / d / sqrt(greatest((s2 - s1 * s1 / d) / (d - 1), 0)) ELSE 0 END AS held FROM ht WHERE d >= 60),
  j AS (SELECT fold, config, count(held) AS judged, count(*) FILTER (round(own - held, 12) > 0) AS wins FROM rq LEFT JOIN hq USING (fold, peer) GROUP BY 1, 2)"""


@query("peers_eligible", f"{SQL_CONFIGS}, {_PEERS} SELECT fold, config, CASE WHEN judged >= 3 THEN judged ELSE 0 END AS judged FROM j WHERE judged < 3 OR wins >= 0.2 * judged")
def peers_eligible(spark: SparkSession, sf: str) -> DataFrame:
    """Which configurations a window may choose from, judged by their ratios against holding on every region."""
    from ravelin.plans.record_queries import config_nets

    rec = config_nets(spark, sf)
    hold = rec.where("config = 0").select("peer", "day", F.col("market").alias("r"))
    return S.beats_on_peers(rec.select("peer", "config", "day", "r"), hold, S.folds(rec.select("day")), share=0.2).select("fold", "config", F.col("judged").cast("long").alias("judged"))


@query("wf_choose_peers", f"""{SQL_CONFIGS}, {_PEERS}, el AS (SELECT fold, config, CASE WHEN judged >= 3 THEN judged ELSE 0 END AS judged FROM j WHERE judged < 3 OR wins >= 0.2 * judged), {SQL_CHOSEN},
  pk AS (SELECT q.fold, q.config, q.sharpe, el.judged, row_number() OVER (PARTITION BY q.fold ORDER BY q.sharpe DESC, q.config) AS nth FROM q JOIN el USING (fold, config)) SELECT fold, config, round(sharpe, 6) AS sharpe, judged FROM pk WHERE nth = 1""")
def choose_peers(spark: SparkSession, sf: str) -> DataFrame:
    """The best configuration of each window among those whose ratios beat holding's on a fifth of the regions."""
    from ravelin.plans.record_queries import config_nets, config_records

    rec, whole = config_nets(spark, sf), config_records(spark, sf)
    hold = rec.where("config = 0").select("peer", "day", F.col("market").alias("r"))
    fold = S.folds(whole)
    good = S.beats_on_peers(rec.select("peer", "config", "day", "r"), hold, fold, share=0.2)
    t = S.train_sharpe(whole, fold).where(F.col("n") >= S.LEAST_DAYS).join(good, ["fold", "config"]).withColumn("sharpe", F.round("sharpe", 9))
    nth = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("sharpe"), "config"))
    return rounded(t.withColumn("nth", nth).where("nth = 1").select("fold", "config", "sharpe", F.col("judged").cast("long").alias("judged")))


@query("switch_costs", f"""{SQL_CONFIGS}, {SQL_CHOSEN}, w AS (SELECT fold, config, (config + 1 + fold) % 9 AS before FROM chosen), s AS (SELECT w.fold, f.test_start, w.config, w.before FROM w JOIN folds f USING (fold) WHERE w.config <> w.before),
  a AS (SELECT s.fold, x.instrument, arg_max(x.side, x.ts) AS a FROM s JOIN sides x ON x.config = s.config AND x.ts < s.test_start GROUP BY 1, 2), b AS (SELECT s.fold, x.instrument, arg_max(x.side, x.ts) AS b FROM s JOIN sides x ON x.config = s.before AND x.ts < s.test_start GROUP BY 1, 2)
  SELECT fold, round(sum(abs(a - b)) / 5 * 0.0005, 8) AS cost FROM a JOIN b USING (fold, instrument) GROUP BY 1""")
def switch_costs(spark: SparkSession, sf: str) -> DataFrame:
    """What turning another configuration's sides into the chosen one's would cost on each window's first day."""
    from ravelin.plans.record_queries import FASTS, GRID, SLOWS, config_records

    rec = config_records(spark, sf)
    fold = S.folds(rec)
    chosen = S.choose(rec, fold).withColumn("before", (F.col("config") + 1 + F.col("fold")) % len(GRID)).where("before <> config").join(fold.select("fold", "test_start"), "fold")
    b = V.bars_region(spark, sf).select("instrument", "ts", *(I.sma("close", n).alias(f"s{n}") for n in FASTS + SLOWS))
    side = F.array(*(F.coalesce(I.cross(f"s{f}", f"s{s}"), F.lit(0.0)) for _, f, s in GRID))
    b = b.select("instrument", "ts", side.alias("sides"))
    asks = chosen.join(b.select("instrument").distinct())  # switches of the calendar, for each name
    last = as_of(asks, b, "instrument", "test_start", "ts", ["sides"], strict=True)
    apart = F.abs(F.element_at("sides", F.col("config") + 1) - F.element_at("sides", F.col("before") + 1))
    return last.groupBy("fold").agg(F.round(F.sum(apart) / 5 * 0.0005, 8).alias("cost"))


@query("neighbour_lists")
def neighbour_lists(spark: SparkSession, sf: str) -> DataFrame:
    """A walk-forward on the lists next to a Top-10 list: whether its result hangs on the names at the list's edge."""
    from ravelin.plans.robust import next_to

    bars, out = kept(V.bars_brand(spark, sf), "bars"), []
    for n in next_to(10):
        e = evaluate(bars, T.STRATEGIES["gtaa_faber"], member=top_members(bars, n))
        out.append(M.core(e.out_of_sample).select(F.lit(n).alias("names"), "days", "sharpe", "cagr"))
    return rounded(reduce(DataFrame.unionByName, out))


@query("half_held_start", f"WITH {V.SQL_NATION}, c AS (SELECT ts, count(*) AS n FROM bars GROUP BY 1) SELECT min(ts) AS start FROM c WHERE n >= ceil((SELECT count(DISTINCT instrument) FROM bars) / 2)")
def half_held(spark: SparkSession, sf: str) -> DataFrame:
    b = V.bars_nation(spark, sf)
    size = F.broadcast(b.agg(F.ceil(F.count_distinct("instrument") / 2).alias("half")))  # one row
    return b.groupBy("ts").agg(F.count(F.lit(1)).alias("n")).join(size).where("n >= half").agg(F.min("ts").alias("start"))


def _features(pdf: pd.DataFrame) -> dict:
    x = T.features_of(pdf)
    return {f"f{i:02d}": x[:, i] for i in range(x.shape[1])}


@query("ml_features")
def ml_features(spark: SparkSession, sf: str) -> DataFrame:
    out = X.per_instrument(V.bars_region(spark, sf), _features, {f"f{i:02d}": "double" for i in range(23)})
    return rounded(out.drop("open", "high", "low", "close", "volume", "dollar_volume"))


@query("refit_calendar", f"WITH {V.SQL_REGION}, d AS (SELECT min(ts) AS lo, max(ts) AS hi FROM bars), r AS (SELECT lo + INTERVAL 1 DAY * (365 + 91 * i) AS refit, hi FROM d, (SELECT unnest(range(-2, 100)) AS i)) SELECT r.refit, min(b.ts) AS bar FROM r JOIN bars b ON b.ts >= r.refit WHERE r.refit <= r.hi GROUP BY 1")
def refit_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Refits each 91 days, the first two before a year is over, each on the first bar at or after it."""
    from ravelin.operators.joins import next_bar

    b = V.bars_region(spark, sf).groupBy("ts").agg(F.lit("all").alias("instrument"))
    span = b.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    r = span.select("hi", F.explode(F.transform(F.sequence(F.lit(-2), F.lit(99)), lambda i: F.timestamp_seconds(F.unix_seconds("lo") + (365 + 91 * i) * 86400))).alias("refit")).where("refit <= hi")
    return next_bar(r.select(F.lit("all").alias("instrument"), "refit"), b, "instrument", "refit", []).select("refit", F.col("bar_ts").alias("bar"))


@query("equity_sessions")
def equity_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return calendars.sessions(spark, 1995, 2024).select(F.col("day").cast("timestamp").alias("day"), "open", "close")


@query("equity_4h_segments")
def equity_4h(spark: SparkSession, sf: str) -> DataFrame:
    """Hours of a session in two segments, split at 13:30 in New York, stamped at the segment's end or the session's."""
    days = calendars.sessions(spark, 2024, 2024).select("day", F.col("open").alias("open_at"), F.col("close").alias("close_at"))
    h = V.bars_event(spark, sf).withColumn("start", F.col("ts") - F.expr("INTERVAL 1 HOUR"))
    s = calendars.in_session(h, F.broadcast(days), "start")  # 252 rows a year
    split = F.col("open_at") + F.expr("INTERVAL 4 HOURS")
    s = s.withColumn("end", F.when(F.col("start") < split, F.least(split, "close_at")).otherwise(F.col("close_at")))
    out = s.groupBy("instrument", "end").agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    return out.withColumnRenamed("end", "ts")


@query("spot_pairs", """WITH p AS (SELECT event_type || CASE WHEN event_type = 'view' THEN '1000' ELSE '' END AS perp FROM (SELECT DISTINCT event_type FROM events)), s AS (SELECT DISTINCT event_type AS spot FROM events WHERE event_type <> 'click')
  SELECT perp, spot FROM (SELECT perp, regexp_replace(perp, '1000$', '') AS base FROM p) LEFT JOIN s ON s.spot = base""")
def spot_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The spot series of a perpetual: the name without its multiplier, if it is stored."""
    names = V.table(spark, sf, "events").select("event_type").distinct()
    p = names.select(F.when(F.col("event_type") == "view", F.concat("event_type", F.lit("1000"))).otherwise(F.col("event_type")).alias("perp"))
    s = names.where("event_type <> 'click'").select(F.col("event_type").alias("spot"))
    return p.withColumn("base", F.regexp_replace("perp", "1000$", "")).join(s, F.col("base") == F.col("spot"), "left").select("perp", "spot")


@query("held_prices", f"""WITH {V.SQL_REGION}, s AS (SELECT instrument, ts, close * 0.97 AS spot FROM bars WHERE day(ts) % 3 <> 0), j AS (SELECT b.instrument, b.ts, b.close, s.spot FROM bars b LEFT JOIN s USING (instrument, ts)), k AS (SELECT instrument, median(spot / close) AS k FROM j GROUP BY 1)
  SELECT instrument, ts, round(coalesce(spot, close * k), 8) AS price FROM j JOIN k USING (instrument)""")
def held_prices(spark: SparkSession, sf: str) -> DataFrame:
    b = V.bars_region(spark, sf).select("instrument", "ts", "close")
    j = b.join(b.where(F.dayofmonth("ts") % 3 != 0).select("instrument", "ts", (F.col("close") * 0.97).alias("spot")), ["instrument", "ts"], "left")
    k = j.groupBy("instrument").agg(F.expr("percentile(spot / close, 0.5D)").alias("k"))
    return j.join(k, "instrument").select("instrument", "ts", F.round(F.coalesce("spot", F.col("close") * F.col("k")), 8).alias("price"))


@query("instrument_classes", """SELECT id, split_part(id, ':', 1) AS source, split_part(id, ':', 2) AS symbol, CASE WHEN split_part(id, ':', 1) = 'perp' THEN 'crypto_perp' WHEN split_part(id, ':', 1) = 'spot' THEN 'crypto_spot' WHEN split_part(id, ':', 1) = 'cme' THEN 'commodity'
  WHEN regexp_matches(split_part(id, ':', 2), '^[A-Z]{3}/[A-Z]{3}$') THEN 'fx' ELSE 'us_equity' END AS asset_class FROM (SELECT (['perp', 'spot', 'cme', 'td', 'sh'])[n_nationkey % 5 + 1] || ':' || CASE WHEN n_nationkey % 10 = 3 THEN 'EUR/USD' ELSE replace(n_name, '_', '') END AS id FROM nation)""")
def instrument_classes(spark: SparkSession, sf: str) -> DataFrame:
    """An instrument's class from its source and symbol."""
    source = F.element_at(F.array(*map(F.lit, ("perp", "spot", "cme", "td", "sh"))), F.col("n_nationkey") % 5 + 1)
    symbol = F.when(F.col("n_nationkey") % 10 == 3, "EUR/USD").otherwise(F.replace(F.col("n_name"), F.lit("_"), F.lit("")))
    n = V.table(spark, sf, "nation").select(F.concat_ws(":", source, symbol).alias("id"))
    n = n.withColumn("source", F.split("id", ":")[0]).withColumn("symbol", F.split("id", ":")[1])
    kind = F.when(F.col("source") == "perp", "crypto_perp").when(F.col("source") == "spot", "crypto_spot").when(F.col("source") == "cme", "commodity").when(F.col("symbol").rlike("^[A-Z]{3}/[A-Z]{3}$"), "fx").otherwise("us_equity")
    return n.withColumn("asset_class", kind)


@query("provenance_stamps")
def provenance(spark: SparkSession, sf: str) -> DataFrame:
    """A hash of each strategy's source: a result is stale if its stamp isn't the current one."""
    rows = [(n, hashlib.sha256(inspect.getsource(s.fn).encode()).hexdigest()[:16], len(s.configs())) for n, s in sorted(T.STRATEGIES.items())]
    return spark.createDataFrame(rows, "strategy string, stamp string, configs int")


@query("vol_term_ratio", f"WITH {V.SQL_REGION}, r AS (SELECT *, ln(close / lag(close) {W}) AS r FROM bars), m AS (SELECT instrument, date_trunc('month', ts)::TIMESTAMP AS month, stddev_samp(r) AS s, count(r) AS n FROM r GROUP BY 1, 2) SELECT instrument, month, n, round(s, 6) AS vol, round(s / nullif(lag(s) OVER (PARTITION BY instrument ORDER BY month), 0), 6) AS ratio FROM m WHERE n > 1")
def vol_ratio(spark: SparkSession, sf: str) -> DataFrame:
    r = V.bars_region(spark, sf).withColumn("r", I.log_return())
    m = r.groupBy("instrument", F.date_trunc("month", "ts").alias("month")).agg(F.stddev_samp("r").alias("vol"), F.count("r").alias("n")).where("n > 1")
    before = F.lag("vol").over(Window.partitionBy("instrument").orderBy("month"))
    return m.select("instrument", "month", "n", r6("vol").alias("vol"), r6(F.col("vol") / F.nullif(before, F.lit(0.0))).alias("ratio"))


@query("look_ahead_check")
def look_ahead(spark: SparkSession, sf: str) -> DataFrame:
    """Positions on bars cut at two dates against those on all bars, for every strategy: a difference would be a look ahead."""
    region, brand, nation = (kept(f(spark, sf), "bars") for f in (V.bars_region, V.bars_brand, V.bars_nation))
    paid = V.settlements(spark, sf)
    out = []
    for name, s in sorted(T.STRATEGIES.items()):
        bars, more = (nation, {"settlements": paid}) if name == "funding_carry" else (brand, {}) if s.kind == "panel" else (region, {})
        whole = s.positions(bars, **more)
        for cut in ("1996-01-01", "1998-06-01"):
            before = F.col("ts") < F.lit(cut).cast("timestamp")
            early = s.positions(bars.where(before), **more).withColumnRenamed("position", "cut")
            both = early.join(whole.where(before), ["instrument", "ts"])
            out.append(both.agg(F.count(F.lit(1)).alias("bars"), F.count_if(F.abs(F.col("position") - F.col("cut")) > 1e-9).alias("differ")).select(F.lit(name).alias("strategy"), F.lit(cut).alias("cut"), "bars", "differ"))
    parts = [kept(reduce(DataFrame.unionByName, out[i : i + 10]), "ahead") for i in range(0, len(out), 10)]  # a plan of seventy would be long to make
    return reduce(DataFrame.unionByName, parts)


@query("period_last_closes", f"WITH {V.SQL_REGION} SELECT instrument, date_trunc('month', ts)::TIMESTAMP AS month, arg_max(close, ts) AS close, count(*) AS bars FROM bars GROUP BY 1, 2")
def last_closes(spark: SparkSession, sf: str) -> DataFrame:
    return P.resampled(V.bars_region(spark, sf), F.date_trunc("month", "ts")).select("instrument", F.date_trunc("month", "ts").alias("month"), "close", F.col("n_bars").alias("bars"))


_BOOK = f"""{SQL_CONFIGS.replace("avg(held * r", "sum(held * r").replace(") AS r FROM h GROUP", ") / 5 AS r FROM h GROUP").replace("coalesce((close / lag(close) OVER (", "coalesce((ln(close / lag(close) OVER (").replace(") - 1) * 0.02, 0)", "))) * 0.02, 0)")}, {SQL_CHOSEN},
  turns AS (SELECT f.fold, c.config, lag(c.config) OVER (ORDER BY f.fold) AS last_config, test_start, test_end FROM folds f LEFT JOIN chosen c USING (fold)),
  b AS (SELECT fold, h.config, last_config, instrument, ts, held / 5 AS weight, before / 5 AS had, held * r / 5 AS made, abs(held - before) / 5 * 0.0002 AS paid,
      row_number() OVER (PARTITION BY fold, instrument ORDER BY ts) AS nth FROM h JOIN turns ON turns.config = h.config AND ts >= test_start AND ts < test_end),
  book AS (SELECT b.*, CASE WHEN nth = 1 AND last_config <> b.config THEN abs(had - coalesce(o.before, 0) / 5) * 0.001 ELSE 0 END AS switch
    FROM b LEFT JOIN h o ON o.config = b.last_config AND o.instrument = b.instrument AND o.ts = b.ts),
  rec AS (SELECT ts, sum(made - paid - switch) AS r FROM book GROUP BY ts), eq AS (SELECT ts, coalesce(exp(sum(ln(1 + r)) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS equity FROM rec),
  m AS (SELECT book.*, equity, sign(weight)::INTEGER AS side, lag(sign(weight)::INTEGER) OVER w AS was, lag(abs(weight)) OVER w AS wl FROM book JOIN eq USING (ts) WINDOW w AS (PARTITION BY instrument ORDER BY ts)),
  i AS (SELECT *, sum(CASE WHEN side IS DISTINCT FROM was THEN 1 ELSE 0 END) OVER (PARTITION BY instrument ORDER BY ts) AS island, CASE WHEN side IS DISTINCT FROM was THEN coalesce(wl / nullif(wl + abs(weight), 0), 0) ELSE 0 END AS closes FROM m),
  x AS (SELECT instrument, island, side, ts, fold, equity * made - equity * (paid + switch) * (1 - closes) AS made FROM i UNION ALL SELECT instrument, island - 1, NULL, NULL, NULL, -equity * (paid + switch) * closes FROM i WHERE closes > 0),
  ledger AS (SELECT instrument, max(side) AS side, min(ts) AS entry_time, max(ts) AS exit_time, count(ts) AS bars, count(DISTINCT fold) AS folds, sum(made) AS made FROM x GROUP BY instrument, island HAVING max(side) <> 0 OR abs(sum(made)) > 1e-15)"""


def chosen_book(spark: SparkSession, sf: str) -> DataFrame:
    """The stitched book of the grid of crosses on all regions, each a fifth of the equity."""
    from ravelin.operators.stitch import stitched_book
    from ravelin.plans.record_queries import COST, FASTS, GRID, SLOWS
    b = V.bars_region(spark, sf).withColumn("r", F.coalesce(F.log(F.col("close") / F.lag("close").over(I.own())) * 0.02, F.lit(0.0)))
    b = b.select("instrument", "ts", "r", *(I.sma("close", n).alias(f"s{n}") for n in FASTS + SLOWS))
    side = [F.struct(F.lit(i).alias("config"), F.coalesce(I.cross(f"s{f}", f"s{s}"), F.lit(0.0)).alias("side")) for i, f, s in GRID]
    w = Window.partitionBy("config", "instrument").orderBy("ts")
    p = b.select("instrument", "ts", "r", F.explode(F.array(*side)).alias("c")).select("instrument", "ts", "r", "c.config", "c.side")
    p = p.withColumns({"held": F.coalesce(F.lag("side").over(w), F.lit(0.0)), "had": F.coalesce(F.lag("side", 2).over(w), F.lit(0.0))})
    parts = p.select("config", "instrument", "ts", (F.col("held") / 5).alias("weight"), (F.col("held") * F.col("r") / 5).alias("made"), (F.abs(F.col("held") - F.col("had")) / 5 * COST).alias("paid"))
    parts = kept(parts, "parts")
    rec = parts.groupBy("config", F.col("ts").alias("day")).agg(F.sum(F.col("made") - F.col("paid")).alias("r"))
    fold = S.folds(rec)
    return kept(stitched_book(parts, fold, S.choose(rec, fold), 0.001), "book")


@query("stitched_ledger", f"{_BOOK} SELECT instrument, side, entry_time, exit_time, bars, folds, round(made, 8) AS made FROM ledger")
def stitched_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The walk-forward's trades as one account has them, switches charged to the trades that they close or open."""
    from ravelin.operators.stitch import ledger

    return ledger(chosen_book(spark, sf)).withColumn("made", F.round("made", 8))


@query("stitched_sums", f"{_BOOK} SELECT instrument, round(sum(made), 8) AS made, count(*) AS trades, (SELECT round(exp(sum(ln(1 + r))) - 1, 8) FROM rec) AS record FROM ledger GROUP BY instrument")
def stitched_sums(spark: SparkSession, sf: str) -> DataFrame:
    """What each name made, beside the record's whole gain: the names' sums are the record."""
    from ravelin.operators.stitch import ledger, record_of

    book = chosen_book(spark, sf)
    gain = record_of(book).agg(F.round(F.exp(F.sum(F.log1p("r"))) - 1, 8).alias("record"))  # one row
    return ledger(book).groupBy("instrument").agg(F.round(F.sum("made"), 8).alias("made"), F.count(F.lit(1)).alias("trades")).join(F.broadcast(gain))
