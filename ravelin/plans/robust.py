"""Whether an out-of-sample result is robust: twelve checks measured on an evaluation, and their pass rules.

Each check is a small DataFrame (check, figure, value); `judged` turns the figures of many results into states.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.operators import books as B
from ravelin.operators import luck as L
from ravelin.operators import metrics as M
from ravelin.operators import selection as S
from ravelin.plans.evaluate import Evaluation, daily_of, evaluate, stitch
from ravelin.plans.strategies import STRATEGIES, Strategy
from ravelin.sources.store import kept

#: What the checks ask for.
KEEP, PBO_MOST, ERAS_LEAST, NAMES_LEAST, RULE_T, PROBABILITY, P_MOST, PEERS, COST_MULTIPLE = 0.5, 0.5, 0.6, 0.5, 2.0, 0.95, 0.05, 0.5, 3.0
SEEDS = (1, 2, 3, 4)
CHECKS = ("luck", "vs_hold", "timing", "pbo", "plateau", "eras", "best_year", "delay", "costs", "names", "neighbour_lists", "seeds", "vs_rule")


def figures(df: DataFrame, check: str, **values: Column) -> DataFrame:
    """(check, figure, value) of one row or several; n numbers the rows of a figure."""
    one = F.array(*(F.struct(F.lit(k).alias("figure"), v.cast("double").alias("value")) for k, v in values.items()))
    return df.select(F.lit(check).alias("check"), F.explode(one).alias("x")).select("check", "x.figure", "x.value")


def earnings(record: DataFrame) -> DataFrame:
    """One row per key: sharpe and cagr."""
    return M.core(record).select("key", "sharpe", "cagr")


def cost_multiple(classes: DataFrame, multiple: float = COST_MULTIPLE) -> Column:
    """How many times its costs a list is charged: `multiple`, or more where a class has a stress cost. classes: modelled, stress."""
    return F.greatest(F.lit(multiple), F.coalesce(F.max(F.col("stress") / F.nullif("modelled", F.lit(0.0))), F.lit(0.0)))


def next_to(n: int) -> tuple[int, int]:
    """The lengths of the lists next to a Top-n list: a fifth of n away in steps of five, five at least and half of n at most."""
    apart = min(max(5, round(n * 0.2 / 5) * 5), n // 2)
    return n - apart, n + apart


def plateau(e: Evaluation) -> DataFrame:
    """Of the configuration that most windows chose (the latest of those chosen as often), its ratio and its neighbours'."""
    days = e.out_of_sample.select("day")
    counts = e.chosen.groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.max("fold").alias("last"))
    top = counts.orderBy(F.desc("n"), F.desc("last")).first()
    if top is None:
        return figures(days.limit(0), "plateau", none=F.lit(None))
    here = e.configs[top.config]

    def step(other: dict) -> bool:
        moved = [k for k in here if here[k] != other[k]]
        if len(moved) != 1:
            return False
        values = list(e.strategy.grid[moved[0]])
        numbers = all(v is None or isinstance(v, (int, float)) and not isinstance(v, bool) for v in values)
        return (len(values) == 2 or numbers) and abs(values.index(other[moved[0]]) - values.index(here[moved[0]])) == 1

    near = [i for i, c in enumerate(e.configs) if step(c)]
    rec = e.records.where(F.col("config").isin([top.config, *near])).join(days, "day", "left_semi").select(F.col("config").cast("string").alias("key"), "day", "r")
    x = earnings(rec)
    own = figures(x.where(F.col("key") == str(top.config)), "plateau", sharpe=F.col("sharpe"))
    return own.unionByName(figures(x.where(F.col("key") != str(top.config)), "plateau", near_sharpe=F.col("sharpe"), near_cagr=F.col("cagr")))


def replayed(e: Evaluation, strategy: Strategy, configs: dict[int, dict], delay: int = 0, books: DataFrame | None = None) -> DataFrame:
    """(config, day, r) of numbered configurations under other books, written once."""
    from ravelin.plans.evaluate import books_of

    more = {k: v for k, v in e.more.items() if k not in ("bars", "length")}
    books = books if books is not None else books_of(e.more["bars"], strategy, configs, **more)
    return kept(daily_of(B.run_books(books, strategy.kind, configs, e.costs, delay), length=e.more["length"]), "replayed")


def luck_bars(e: Evaluation, extra: int = 0, draws: int = L.DRAWS) -> tuple[float, float]:
    """(independent tries, t that their best reaches one time in twenty by luck) of a grid: the tries from its records, the t from
    what they earn over holding, which is less alike."""
    own = e.records.select(F.lit(e.strategy.name).alias("family"), F.col("config").alias("key"), "day", "r")
    over = own.join(e.benchmark.select("day", F.col("r").alias("b")), "day").select("family", "key", "day", (F.col("r") - F.col("b")).alias("r"))
    every = [L.luck_of(x, extra, draws).where(F.col("family") == L.ALL).first() for x in (own, over)]
    return (every[0].independent if every[0] else 1.0), (every[1].best_95 if every[1] else L.ONE_TRY)


def measure(e: Evaluation, tries: float = 100, lists: dict[int, DataFrame] | None = None, base: Strategy | None = None) -> DataFrame:
    """(check, figure, value) of every check that applies. tries: evaluations made, which the luck check counts.

    lists: memberships of the neighbouring lists by length; base: the rule under a model.

    Each check's few figures are written as it is made: one plan of all checks has thousands of nodes, which the driver would
    have to hold and describe anew after each of its stages.
    """
    oos = kept(e.out_of_sample, "measured")
    mc = L.monte_carlo(oos).where("figure = 'sharpe'")
    out = [figures(mc, "luck", mc_p5=F.col("p5")), figures(L.deflated(oos, tries), "luck", probability=F.col("probability"))]
    paired = L.paired(oos.join(e.benchmark.select("day", F.col("r").alias("b")), "day", "left").select("key", "day", F.col("r").alias("a"), "b"))
    out.append(figures(paired, "vs_hold", t=F.col("t"), sharpe=F.col("sharpe"), other=F.col("sharpe_other")))
    days = oos.select("day")
    if len(e.configs) > 1:
        within = e.records.join(days, "day", "left_semi")
        out.append(figures(S.overfitting_share(within), "pbo", pbo=F.col("pbo"), splits=F.col("splits")))
        out.append(plateau(e))
    out.append(figures(S.consistency(oos), "eras", rho=F.col("rho"), windows=F.col("windows")))
    out.append(figures(M.best_year(oos), "best_year", avg_monthly=F.col("avg_monthly"), rest=F.col("without")))
    # What was held, for the timing of the whole and what each name made.
    taken = sorted(r.config for r in e.chosen.select("config").distinct().collect()) if len(e.configs) > 1 else [0]  # a grid's configurations at most
    used = e.books.where(F.col("config").isin(taken)) if len(e.configs) > 1 else e.books
    held = B.held_weights(used, e.strategy.kind, e.configs, e.costs)
    if len(e.configs) > 1:
        turns = e.folds.join(e.chosen.select("fold", "config"), "fold")
        held = held.join(F.broadcast(turns), "config").where((F.col("ts") >= F.col("test_start")) & (F.col("ts") < F.col("test_end")))  # the calendar over the step
    held = kept(held.select(F.lit("book").alias("key"), "instrument", "ts", "weight", "gap", "session", "funding", "member"), "held")
    out.append(figures(L.random_timing(held, rate=e.costs.rate, borrow=e.costs.borrow), "timing", p=F.col("p"), null_median=F.col("null_median")))
    before = F.coalesce(F.lag("weight").over(Window.partitionBy("instrument").orderBy("ts")), F.lit(0.0))
    made = held.withColumn("made", before * F.coalesce("gap", F.lit(0.0)) + F.col("weight") * (F.coalesce("session", F.lit(0.0)) - F.col("funding")) - F.abs(F.col("weight") - before) * e.costs.rate)
    traded = made.groupBy("instrument").agg(F.sum("made").alias("made"), F.max(F.abs("weight")).alias("most")).where("most > 0")
    out.append(figures(traded.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("made") > 0).cast("double")).alias("share")), "names", share=F.col("share"), names=F.col("n")))
    stressed = daily_of(e.walks, (1 + F.col("gross")) * (1 - COST_MULTIPLE * F.col("cost")) - 1 - F.col("carry"), e.more["length"])
    out.append(figures(earnings(stitch(e, stressed, COST_MULTIPLE)), "costs", sharpe=F.col("sharpe"), cagr=F.col("cagr")))
    out.append(figures(earnings(stitch(e, replayed(e, e.strategy, dict(enumerate(e.configs)), 1, used))), "delay", sharpe=F.col("sharpe"), cagr=F.col("cagr")))
    for n, member in (lists or {}).items():
        near = evaluate(e.more["bars"], e.strategy, e.configs, e.costs, **({k: v for k, v in e.more.items() if k != "bars"} | {"member": member}))
        out.append(figures(earnings(near.out_of_sample.withColumn("key", F.lit(str(n)))), "neighbour_lists", near_sharpe=F.col("sharpe"), near_cagr=F.col("cagr")))
    if base is not None:
        own, n = {i: e.configs[i] for i in taken or [0]}, len(e.configs)
        seeded = replayed(e, e.strategy, {k * n + i: c | {"seed": seed} for k, seed in enumerate(SEEDS) for i, c in own.items()})
        seeded = seeded.select(F.floor(F.col("config") / n).cast("string").alias("key"), (F.col("config") % n).alias("config"), "day", "r")
        again = S.stitched(seeded, e.folds, e.chosen, e.costs.rate, ["key"]) if n > 1 else seeded
        out.append(figures(earnings(again.select("key", "day", "r")), "seeds", near_sharpe=F.col("sharpe"), near_cagr=F.col("cagr")))
        plain = stitch(e, replayed(e, base, {i: {k: v for k, v in c.items() if k != "threshold"} for i, c in own.items()}))
        t = L.paired(oos.withColumnRenamed("r", "a").join(plain.select("day", F.col("r").alias("b")), "day", "left"))
        out.append(figures(t, "vs_rule", t=F.col("t"), plain=F.col("sharpe_other")))
    with ThreadPoolExecutor(2) as jobs:  # checks know nothing of each other, and each is a few short jobs; the driver holds the plans of those at work
        return reduce(DataFrame.unionByName, list(jobs.map(lambda made: kept(made, "check"), out)))


def judged(measured: DataFrame, sharpe: DataFrame, bar: float) -> DataFrame:
    """(key, check, state, worst) of every check of every result: passed, failed, too_short or not_measured.

    measured: key, check, figure, value (null: too short to say); sharpe: key, sharpe of each result; bar: the t that luck
    reaches one time in twenty. A record that makes no money is not checked.
    """
    v = lambda check, figure, how=F.max: how(F.when((F.col("check") == check) & (F.col("figure") == figure), F.col("value")))
    n = lambda check: F.count_if(F.col("check") == check)
    wide = measured.groupBy("key").agg(
        *(n(c).alias(f"n_{c}") for c in CHECKS), v("luck", "mc_p5").alias("mc"), v("luck", "probability").alias("prob"), v("vs_hold", "t").alias("t"), v("timing", "p").alias("p"), v("pbo", "pbo").alias("pbo"),
        v("plateau", "sharpe").alias("top"), v("plateau", "near_sharpe", F.min).alias("near"), v("plateau", "near_cagr", F.min).alias("near_cagr"), v("plateau", "near_sharpe", F.median).alias("middle"), v("eras", "rho").alias("rho"),
        v("best_year", "avg_monthly").alias("month"), v("best_year", "rest").alias("rest"), v("delay", "sharpe").alias("late"), v("delay", "cagr").alias("late_cagr"), v("costs", "sharpe").alias("dear"), v("costs", "cagr").alias("dear_cagr"),
        v("names", "share").alias("names"), v("neighbour_lists", "near_sharpe", F.min).alias("lists"), v("neighbour_lists", "near_cagr", F.min).alias("lists_cagr"), v("seeds", "near_sharpe", F.min).alias("seeds"),
        v("seeds", "near_cagr", F.min).alias("seeds_cagr"), v("vs_rule", "t").alias("rule_t"),
    ).join(sharpe.select("key", F.col("sharpe").alias("own")), "key")
    c = F.col
    rules = {
        "luck": ("mc", (c("mc") > 0) & (c("prob") >= PROBABILITY)), "vs_hold": ("t", c("t") >= bar), "timing": ("p", c("p") < P_MOST), "pbo": ("pbo", c("pbo") <= PBO_MOST),
        "plateau": ("near", (c("near") > 0) & (c("near_cagr") > 0) & (c("middle") >= KEEP * c("top"))), "eras": ("rho", c("rho") >= ERAS_LEAST), "best_year": ("rest", c("rest") >= KEEP * c("month")),
        "delay": ("late", (c("late") > 0) & (c("late_cagr") > 0)), "costs": ("dear", (c("dear") > 0) & (c("dear_cagr") > 0)), "names": ("names", c("names") >= NAMES_LEAST),
        "neighbour_lists": ("lists", (c("lists_cagr") > 0) & (c("lists") > 0) & (c("lists") >= KEEP * c("own"))), "seeds": ("seeds", (c("seeds_cagr") > 0) & (c("seeds") > 0) & (c("seeds") >= KEEP * c("own"))),
        "vs_rule": ("rule_t", c("rule_t") >= RULE_T),
    }
    state = lambda k, value, ok: F.when(c(f"n_{k}") == 0, "not_measured").when(c(value).isNull() | ok.isNull(), "too_short").when(ok, "passed").otherwise("failed")
    rows = F.array(*(F.struct(F.lit(k).alias("check"), state(k, value, ok).alias("state"), c(value).alias("worst")) for k, (value, ok) in rules.items()))
    return wide.select("key", F.explode(rows).alias("x")).select("key", "x.*")


def board(states: DataFrame, cards: DataFrame) -> DataFrame:
    """A row per result in the board's order: money makers first, then by checks passed, targets met and ratio."""
    s = states.groupBy("key").agg(F.count_if(F.col("state") == "passed").alias("passed"), F.count_if(F.col("state") != "not_measured").alias("applicable"))
    rows = cards.join(s, "key", "left").fillna(0, ["passed", "applicable"])
    w = Window.orderBy(F.desc(F.col("cagr") > 0), F.desc("passed"), F.desc("targets_met"), F.desc("sharpe"), "key")  # a board: one row per result
    return rows.select(F.row_number().over(w).alias("place"), "key", "cagr", "sharpe", "targets_met", "passed", "applicable")


def base_of(name: str) -> Strategy | None:
    """The rule under a graded one."""
    under = {"ibs": "ibs", "rsi2": "rsi2_connors", "bollinger": "bollinger_reversion", "trend_or_revert": "trend_or_revert"}
    return next((STRATEGIES[b] for p, b in under.items() if name in (f"{p}_ml_filter", f"{p}_ml_sized")), None)
