"""A strategy on a list, end to end: positions of every configuration, books, walk-forward, figures, targets and checks."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions import recursion as X
from ravelin.operators import books as B
from ravelin.operators import metrics as M
from ravelin.operators import selection as S
from ravelin.operators import walks as K
from ravelin.operators.intrabar import exits_inside
from ravelin.operators.joins import as_of
from ravelin.plans.strategies import ALONE, DAILY, Strategy
from ravelin.sources.store import kept


@dataclass
class Evaluation:
    strategy: Strategy
    configs: list[dict[str, Any]]
    books: DataFrame  # the rows of every configuration's book
    walks: DataFrame  # config, ts and the account's figures
    records: DataFrame  # config, day, r
    folds: DataFrame
    chosen: DataFrame
    out_of_sample: DataFrame  # key, day, r
    benchmark: DataFrame  # key, day, r
    card: DataFrame
    costs: K.Costs
    more: dict[str, Any] = field(default_factory=dict)


def books_of(
    bars: DataFrame, strategy: Strategy, configs: list[dict[str, Any]] | dict[int, dict[str, Any]], member: DataFrame | None = None, carry: DataFrame | None = None, quotes: DataFrame | None = None,
    minutes: DataFrame | None = None, **more: Any,
) -> DataFrame:
    """The rows of every configuration's book: positions are made once for configurations that differ in the account's axes only.

    configs: in order, or by their numbers. minutes: bars of a minute; with them exits are walked inside bars, once per signal and set of exits.
    """
    names = kept(B.held_by(bars, member), "names") if member is not None else None
    own = bars.join(names, "instrument", "left_semi") if names is not None and strategy.name in ALONE else bars
    signals: dict[str, tuple[int, dict]] = {}
    variants: dict[tuple, int] = {}
    of = []
    numbered = configs if isinstance(configs, dict) else dict(enumerate(configs))
    for i, c in numbered.items():
        own_ = strategy.signal(c)
        signal = signals.setdefault(repr(sorted(own_.items())), (len(signals), own_))[0]
        rule = B.rule_of(c)
        of.append((i, signal, None if rule == K.Exits() or minutes is None else variants.setdefault((signal, rule, c.get("trail_every") or "bar"), len(variants))))
    positions = strategy.positions_of(own, [params for _, params in signals.values()], **more)
    table = bars.sparkSession.createDataFrame(of, "config int, signal int, variant int")
    inside = None
    if variants:
        positions = kept(positions, "positions")
        sides = positions.groupBy("instrument", "ts").agg(F.map_from_entries(F.collect_list(F.struct("signal", F.signum("position").alias("side")))).alias("of"))  # as many as signals
        sides = sides.select("instrument", "ts", F.array(*(F.coalesce(F.col("of")[s], F.lit(0.0)) for s, _, _ in variants)).alias("sides"))
        measured = X.recursive(own.select("instrument", "ts", "open", "high", "low", "close"), atr=("atr", B.ATR)).join(sides, ["instrument", "ts"], "left")
        inside = kept(exits_inside(measured, minutes, [r for _, r, _ in variants], [e for _, _, e in variants]), "inside")
    return B.wanted_books(bars, positions, table, member, carry, quotes, inside, names)


def daily_of(walks: DataFrame, value: Any = "net", length: str = "1 day") -> DataFrame:
    """(config, day, r): an account's returns by UTC day of the bars' closes. length: how long after its stamp a bar closes."""
    r = F.col(value) if isinstance(value, str) else value
    day = walks.select(F.col("config").cast("string").alias("key"), (F.col("ts") + F.expr(f"INTERVAL {length}")).alias("ts"), r.alias("r"))
    return M.daily(day, "ts", "r").select(F.col("key").cast("int").alias("config"), "day", "r")


def records_of(bars: DataFrame, strategy: Strategy, configs: list[dict[str, Any]], costs: K.Costs, length: str | None = None, **more: Any) -> DataFrame:
    """(config, day, r) of each configuration's account."""
    length = length or more.get("market", DAILY).length
    return daily_of(B.run_books(books_of(bars, strategy, configs, **more), strategy.kind, configs, costs), length=length)


def stitch(e: Evaluation, records: DataFrame, scale: float = 1.0) -> DataFrame:
    """(key, day, r) of other records of the same configurations over the same choices."""
    if len(e.configs) == 1:
        return records.select(F.lit(e.strategy.name).alias("key"), "day", "r")
    return S.stitched(records, e.folds, e.chosen, e.costs.rate * scale).select(F.lit(e.strategy.name).alias("key"), "day", "r")


def benchmark(e: Evaluation) -> DataFrame:
    """(key, day, r) of the list's members bought alike and held from the record's first day, by the same account's costs."""
    first = e.out_of_sample.agg(F.min("day")).first()[0]
    since = (first or datetime(1970, 1, 1)) - timedelta(days=1)
    held = B.bought_and_held(e.more["bars"], e.costs.rate, since, e.more.get("member"))
    day = daily_of(held.withColumn("config", F.lit(0)), length=e.more["length"])
    return day.select(F.lit(e.strategy.name).alias("key"), "day", "r").join(e.out_of_sample.select("day"), "day", "left_semi").select("key", "day", "r")


def evaluate(bars: DataFrame, strategy: Strategy, configs: list[dict[str, Any]] | None = None, costs: K.Costs | None = None, length: str | None = None, **more: Any) -> Evaluation:
    """The whole grid walked forward. more: member, carry, quotes, minutes, market, and what the strategy itself asks for.

    market: class and timeframe of the bars, by which spans in days and months are turned into bars. length: how long
    after its stamp a bar closes, if it isn't as the market says.

    Bars, what is given with them and walks are written once to the shared folder; every signal, figure and check reads them
    there. Minutes are read where they lie.
    """
    bars = kept(bars, "bars")
    more = {k: kept(v, k) if isinstance(v, DataFrame) and k != "minutes" else v for k, v in more.items()}
    costs, length = costs or K.Costs(0.0005, 0.005), length or more.get("market", DAILY).length
    names = bars.select("instrument").distinct().count()
    configs = configs or strategy.configs(names)
    books = kept(books_of(bars, strategy, configs, **more), "books")
    walks = kept(B.run_books(books, strategy.kind, configs, costs), "walks")
    records = kept(daily_of(walks, length=length), "records")
    folds = S.folds(records)
    chosen = kept(S.choose(records, folds), "chosen")
    e = Evaluation(strategy, configs, books, walks, records, folds, chosen, records, records, records, costs, {"bars": bars, "length": length} | more)
    e.out_of_sample = kept(stitch(e, records), "oos")
    e.benchmark = kept(benchmark(e), "benchmark")
    oos = e.out_of_sample
    card = M.core(oos).join(M.vs_hold(oos, e.benchmark), "key", "left").withColumn("beats_hold", F.coalesce(F.col("vs_hold") > 0, F.lit(False)))
    e.card = M.targets(card).join(M.k_ratio(oos), "key", "left").join(M.best_year(oos).select("key", F.col("without").alias("without_best_year")), "key", "left")
    return e


def alone(bars: DataFrame, strategy: Strategy, costs: K.Costs | None = None, **more: Any) -> DataFrame:
    """(key, config, day, r, position): every configuration of a rule's grid on each instrument alone; position is what a day's last bar held.

    Axes that choose among names (slots), or that need minutes, have one value here.
    """
    costs, length = costs or K.Costs(0.0005, 0.005), more.get("market", DAILY).length
    grid = {k: [None] if k == "slots" else ["bar"] if k == "trail_every" else v for k, v in strategy.grid.items()}
    params = replace(strategy, grid=grid).configs()
    signals: dict[str, tuple[int, dict]] = {}
    of = [signals.setdefault(repr(sorted(own.items())), (len(signals), own))[0] for own in map(strategy.signal, params)]
    table = bars.sparkSession.createDataFrame(list(enumerate(of)), "config int, signal int")
    books = B.wanted_books(bars, strategy.positions_of(bars, [p for _, p in signals.values()], **more), table)

    def one(pdf: Any) -> Any:
        ts, names, _, a = B.walked(pdf, strategy.kind, params[int(pdf["config"].iloc[0])], costs)
        return pd.DataFrame({"key": names[0], "config": pdf["config"].iloc[0], "ts": ts, "net": a.net, "position": a.weights.sum(axis=1)})

    spread = books.repartition(4 * bars.sparkSession.sparkContext.defaultParallelism, "instrument", "config")  # little data, much work: not to be coalesced
    walks = kept(spread.groupBy("instrument", "config").applyInPandas(one, "key string, config int, ts timestamp, net double, position double"), "alone")
    walks = walks.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {length}")).withColumn("both", F.struct("key", "config"))
    held = walks.groupBy("both", F.date_trunc("day", F.col("ts") - F.expr("INTERVAL 1 MICROSECOND")).alias("day")).agg(F.max_by("position", "ts").alias("position"))
    r = M.daily(walks.select(F.col("both").alias("key"), "ts", F.col("net").alias("r")), "ts", "r").withColumnRenamed("key", "both")
    return r.join(held, ["both", "day"], "left").select("both.*", "day", "r", "position")


def pick(records: DataFrame, cost: float = 0.0005) -> tuple[DataFrame, DataFrame]:
    """Per key, candidates' records (key, config, day, r, position) walked forward: (choices, key/day/config/r/position of the chosen).

    A switch pays the cost of turning what the candidate before held, the day before, into what the new one held then. A
    window in which no candidate can be chosen holds nothing.
    """
    folds = S.folds(records)
    chosen = S.choose(records, folds, ["key"])
    w = Window.partitionBy("key").orderBy("fold")
    dated = records.select("key").distinct().join(F.broadcast(folds))  # the calendar over the step, for each key
    dated = dated.join(chosen.select("key", "fold", "config"), ["key", "fold"], "left").withColumns({"before": F.lag("config").over(w), "nth": F.row_number().over(w)})
    turns = dated.where("nth > 1 AND NOT config <=> before").select("key", F.col("test_start").alias("day"), "config", "before")
    at = lambda c: F.struct("key", F.col(c).alias("config"))
    held = records.where("position IS NOT NULL").select(F.struct("key", "config").alias("of"), "day", "position")
    asks = turns.select("key", "day", F.explode(F.array(F.struct(at("config").alias("of"), F.lit(1).alias("sign")), F.struct(at("before").alias("of"), F.lit(-1).alias("sign")))).alias("x")).select("key", "day", "x.*")
    turned = as_of(asks, held, "of", "day", "day", ["position"], strict=True).groupBy("key", "day")
    turned = turned.agg(F.abs(F.sum(F.col("sign") * F.coalesce("position", F.lit(0.0)))).alias("turned"))
    days = dated.select("key", "config", F.explode(F.sequence("test_start", F.expr("test_end - INTERVAL 1 DAY"), F.expr("INTERVAL 1 DAY"))).alias("day"))
    out = days.join(records, ["key", "config", "day"], "left").join(turned, ["key", "day"], "left")
    paid = (1 + F.coalesce("r", F.lit(0.0))) * (1 - cost * F.coalesce("turned", F.lit(0.0))) - 1
    last = F.coalesce(F.last("position", ignorenulls=True).over(Window.partitionBy("key", "config").orderBy("day")), F.lit(0.0))
    return chosen, out.select("key", "day", "config", paid.alias("r"), F.when(F.col("config").isNotNull(), last).otherwise(0.0).alias("position"))


LEAST_BARS, LEAST_MONTHS = 100, 6  # fixed values: what an instrument must have to be scored alone


def walked_alone(bars: DataFrame, strategy: Strategy, **more: Any) -> DataFrame:
    """(key, day, config, r, position): a rule's grid walked forward on each instrument for itself.

    Instruments of fewer than 100 bars, and records of fewer than six whole months, are left out.
    """
    enough = bars.where("close IS NOT NULL").groupBy("instrument").agg(F.count(F.lit(1)).alias("_bars")).where(F.col("_bars") >= LEAST_BARS)
    _, days = pick(kept(alone(bars.join(enough.select("instrument"), "instrument", "left_semi"), strategy, **more), "candidates"))
    days = kept(days, "walked")
    scored = M.monthly(days.select("key", "day", "r")).groupBy("key").agg(F.count(F.lit(1)).alias("months")).where(F.col("months") >= LEAST_MONTHS)
    return days.join(scored.select("key"), "key", "left_semi")
