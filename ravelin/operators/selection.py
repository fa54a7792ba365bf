"""Walk-forward selection and checks over daily records of many configurations: (config, day, r)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.operators.metrics import YEAR, grown, ratio, safe

FIRST, STEP, LEAST_DAYS = 365, 91, 60


def folds(record: DataFrame, first: int = FIRST, step: int = STEP, train: int | None = None) -> DataFrame:
    """(fold, train_start, test_start, test_end): training grows from the start, tests follow each other; ends are open.

    train: training is the last so many days only.
    """
    if train is not None:
        start = F.timestamp_seconds(F.unix_seconds("test_start") - train * 86400)
        return folds(record, first, step).withColumn("train_start", F.greatest("train_start", start))
    span = record.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    days = F.datediff("hi", "lo") + 1
    n = F.ceil((days - first) / step).cast("int")
    return span.where(days > first).select("lo", "hi", F.explode(F.sequence(F.lit(0), n - 1)).alias("fold")).select(
        "fold", F.col("lo").alias("train_start"), F.timestamp_seconds(F.unix_seconds("lo") + (first + F.col("fold").cast("long") * step) * 86400).alias("test_start"),
        F.least(F.timestamp_seconds(F.unix_seconds("lo") + (first + (F.col("fold").cast("long") + 1) * step) * 86400), F.timestamp_seconds(F.unix_seconds("hi") + 86400)).alias("test_end"),
    )


def train_sums(record: DataFrame, fold: DataFrame, by: list[str]) -> DataFrame:
    """(fold, *by, days, active, s1, s2, log) over each fold's training days.

    Days are summed by the fold step they fall into, and steps are summed up to each fold: every day is read once, whatever
    the number of folds. The table of folds is as long as the calendar over the step."""
    start = F.broadcast(fold.agg(F.min("test_start").alias("t0")))  # one row
    step = F.greatest(F.lit(-1), F.floor((F.unix_seconds("day") - F.unix_seconds("t0")) / (STEP * 86400))).cast("int")
    sums = record.join(start).groupBy(*by, step.alias("step")).agg(
        F.count("r").alias("days"), F.count_if(F.col("r") != 0).alias("active"), F.sum("r").alias("s1"), F.sum(F.col("r") * F.col("r")).alias("s2"), F.sum(F.log1p(safe("r"))).alias("log")
    )
    steps = fold.select((F.col("fold") - 1).alias("step"))
    keys = record.select(*by).distinct().join(F.broadcast(steps))  # the calendar over the step, for each configuration
    w = Window.partitionBy(*by).orderBy("step")
    run = keys.join(sums, [*by, "step"], "left").withColumns({c: F.sum(F.coalesce(c, F.lit(0))).over(w) for c in ("days", "active", "s1", "s2", "log")})
    return run.withColumn("fold", F.col("step") + 1).drop("step")


def train_sharpe(record: DataFrame, fold: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(fold, *by, config, n, sharpe) over each fold's training days."""
    run = train_sums(record, fold, [*(by or []), "config"])
    mean = F.col("s1") / F.nullif(F.col("days"), F.lit(0))
    dev = F.sqrt(F.greatest((F.col("s2") - F.col("days") * mean * mean) / F.nullif(F.col("days") - 1, F.lit(0)), F.lit(0.0)))
    return run.select("fold", *(by or []), "config", F.col("active").alias("n"), (ratio(mean, dev) * F.lit(float(YEAR) ** 0.5)).alias("sharpe"))


def choose(record: DataFrame, fold: DataFrame, by: list[str] | None = None, digits: int = 9) -> DataFrame:
    """(fold, *by, config, sharpe): the best training ratio among configurations with enough active days; ties to the first."""
    t = train_sharpe(record, fold, by).where(F.col("n") >= LEAST_DAYS).withColumn("sharpe", F.round("sharpe", digits))
    nth = F.row_number().over(Window.partitionBy("fold", *(by or [])).orderBy(F.desc("sharpe"), "config"))
    return t.withColumn("nth", nth).where("nth = 1").select("fold", *(by or []), "config", "sharpe")


def choose_within(record: DataFrame, fold: DataFrame, digits: int = 9) -> DataFrame:
    """(fold, config) as choose, on training windows that need not begin with the record: a day is read once per window it is in."""
    d = record.join(F.broadcast(fold.select("fold", "train_start", "test_start")), (F.col("day") >= F.col("train_start")) & (F.col("day") < F.col("test_start")))  # the calendar over the step
    g = d.groupBy("fold", "config").agg(F.count("r").alias("days"), F.count_if(F.col("r") != 0).alias("active"), F.sum("r").alias("s1"), F.sum(F.col("r") * F.col("r")).alias("s2"))
    mean = F.col("s1") / F.col("days")
    dev = F.sqrt(F.greatest((F.col("s2") - F.col("days") * mean * mean) / (F.col("days") - 1), F.lit(0.0)))
    t = g.where(F.col("active") >= LEAST_DAYS).withColumn("sharpe", F.round(ratio(mean, dev) * F.lit(float(YEAR) ** 0.5), digits))
    nth = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("sharpe"), "config"))
    return t.withColumn("nth", nth).where("nth = 1").select("fold", "config")


def window_sharpe(flat: float | None) -> Column:
    """A ratio from sums over a window; flat where it has no deviation (null: never taken)."""
    mean = F.col("s1") / F.nullif(F.col("days"), F.lit(0))
    dev = F.sqrt(F.greatest((F.col("s2") - F.col("days") * mean * mean) / F.nullif(F.col("days") - 1, F.lit(0)), F.lit(0.0)))
    return F.when((F.col("days") > 1) & (dev > 1e-15), mean / dev).otherwise(F.lit(flat).cast("double"))


def beats_on_peers(record: DataFrame, hold: DataFrame, fold: DataFrame, share: float = 0.5, least: int = 3) -> DataFrame:
    """(fold, config, judged) that may be chosen: in training their ratio was over holding's on at least a share of the peers.

    record: peer, config, day, r; hold: peer, day, r, a row for each day with a price. Peers with fewer than LEAST_DAYS such
    days in the window don't judge; with fewer than `least` judges every configuration may be chosen and judged is 0.
    """
    own = train_sums(record, fold, ["peer", "config"]).select("fold", "peer", "config", window_sharpe(None).alias("own"))
    held = train_sums(hold, fold, ["peer"]).where(F.col("days") >= LEAST_DAYS).select("fold", "peer", window_sharpe(0.0).alias("held"))
    both = own.join(held, ["fold", "peer"], "left")
    wins = F.count_if(F.round(F.col("own") - F.col("held"), 12) > 0)
    judged = both.groupBy("fold", "config").agg(F.count("held").alias("judged"), wins.alias("wins"))
    good = (F.col("judged") < least) | (F.col("wins") >= share * F.col("judged"))
    return judged.where(good).select("fold", "config", F.when(F.col("judged") >= least, F.col("judged")).otherwise(0).alias("judged"))


def stitched(record: DataFrame, fold: DataFrame, chosen: DataFrame, cost: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """(day, fold, config, r) of the chosen configurations' test days; a switch is paid on a test's first day.

    by: columns of several records of the same configurations, stitched by the same choices each; they come first."""
    picked = fold.join(chosen.select("fold", "config"), "fold", "left")
    before = F.lag("config").over(Window.orderBy("fold"))  # as long as the folds
    picked = picked.withColumn("switch", F.coalesce(before != F.col("config"), F.lit(False)))
    days = picked.select("fold", "config", "switch", F.col("test_start").alias("first"), F.explode(F.sequence("test_start", F.expr("test_end - INTERVAL 1 DAY"), F.expr("INTERVAL 1 DAY"))).alias("day"))
    days = days.join(F.broadcast(record.select(*by).distinct())) if by else days  # the calendar, for each record
    out = days.join(record, ["config", "day", *(by or [])], "left").withColumn("r", F.coalesce("r", F.lit(0.0)))
    paid = F.when(F.col("switch") & (F.col("day") == F.col("first")), (1 + F.col("r")) * (1 - cost) - 1).otherwise(F.col("r"))
    return out.select(*(by or []), "day", "fold", "config", paid.alias("r"))


def block_sums(record: DataFrame, blocks: int) -> DataFrame:
    """(config, block, days, s1, s2) of blocks of days in a row, the first ones a day longer if they don't come out even."""
    span = F.broadcast(record.agg(F.min("day").alias("lo"), (F.datediff(F.max("day"), F.min("day")) + 1).alias("n")))  # one row
    at, size, over = F.datediff("day", "lo"), F.floor(F.col("n") / blocks), F.col("n") % blocks
    block = F.when(at < over * (size + 1), F.floor(at / (size + 1))).otherwise(over + F.floor((at - over * (size + 1)) / size)).cast("int")
    return record.join(span).groupBy("config", block.alias("block")).agg(F.count(F.lit(1)).alias("days"), F.sum("r").alias("s1"), F.sum(F.col("r") * F.col("r")).alias("s2"))


def splits(spark: SparkSession, blocks: int) -> DataFrame:
    """(split, block, inside): all ways to take half of the blocks."""
    rows = [(s, b, b in take) for s, take in enumerate(combinations(range(blocks), blocks // 2)) for b in range(blocks)]
    return spark.createDataFrame(rows, "split int, block int, inside boolean")


def overfitting(record: DataFrame, blocks: int = 10) -> DataFrame:
    """(split, config, rank_out, n_configs): of each split's best inside, its rank outside (1: the worst).

    Of configurations that tie inside the first is the best; outside they share their mean rank."""
    s = block_sums(record, blocks).join(F.broadcast(splits(record.sparkSession, blocks)), "block")  # C(blocks, half) * blocks rows
    half = s.groupBy("split", "inside", "config").agg(F.sum("days").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    mean = F.col("s1") / F.col("n")
    sharpe = F.round(ratio(mean, F.sqrt(F.greatest((F.col("s2") - F.col("n") * mean * mean) / (F.col("n") - 1), F.lit(0.0)))), 9)
    ranked = half.withColumn("sharpe", sharpe)
    best = F.row_number().over(Window.partitionBy("split", "inside").orderBy(F.desc("sharpe"), "config"))
    ties = F.count(F.lit(1)).over(Window.partitionBy("split", "inside", "sharpe"))
    low = F.rank().over(Window.partitionBy("split", "inside").orderBy("sharpe")) + (ties - 1) / 2
    ranked = ranked.withColumn("best", best).withColumn("low", low).withColumn("n_configs", F.count(F.lit(1)).over(Window.partitionBy("split", "inside")))
    inside = ranked.where("inside AND best = 1").select("split", "config")
    return ranked.where("NOT inside").join(inside, ["split", "config"]).select("split", "config", F.col("low").alias("rank_out"), "n_configs")


def overfitting_share(record: DataFrame, blocks: int = 10) -> DataFrame:
    """The share of splits whose choice lies in the lower half outside."""
    return overfitting(record, blocks).agg(F.count(F.lit(1)).alias("splits"), F.avg((F.col("rank_out") / (F.col("n_configs") + 1) <= 0.5).cast("double")).alias("pbo"))


def eras(record: DataFrame, days: int = 730) -> DataFrame:
    """(key, era, n, gain) by spans of days from a key's first."""
    lo = F.min("day").over(Window.partitionBy("key"))
    era = F.floor(F.datediff("day", F.col("lo")) / days).cast("int")
    return record.withColumn("lo", lo).groupBy("key", era.alias("era")).agg(F.count(F.lit(1)).alias("n"), (grown("r") - 1).alias("gain"))


def consistency(record: DataFrame, days: int = 730, tail: int = 365, least: int = 3) -> DataFrame:
    """(key, windows, rho): half the share of windows with a positive ratio, 0.3 of how little they spread, 0.2 of the worst one.

    Windows are `days` long from a key's first day, the last one counts from `tail` days on; rho is null under `least` windows.
    """
    era = F.floor((F.row_number().over(Window.partitionBy("key").orderBy("day")) - 1) / days)
    w = record.withColumn("era", era).groupBy("key", "era").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"))
    w = w.where(F.col("n") >= tail).withColumn("sharpe", ratio(F.col("mean"), F.col("sd")) * F.lit(float(YEAR) ** 0.5))
    spread = F.greatest(F.least(1 - F.stddev_samp("sharpe") / 2, F.lit(1.0)), F.lit(0.0))
    rho = 0.5 * F.avg((F.col("sharpe") > 0).cast("double")) + 0.3 * spread + 0.2 / (1 + F.exp(-F.min("sharpe")))
    return w.groupBy("key").agg(F.count(F.lit(1)).alias("windows"), F.when(F.count(F.lit(1)) >= least, F.greatest(F.least(rho, F.lit(1.0)), F.lit(0.0))).alias("rho"))


def neighbours(configs: DataFrame, axes: list[str]) -> DataFrame:
    """(config, neighbour): configurations that differ by one step along one axis."""
    numbered = configs.select("config", *(F.dense_rank().over(Window.orderBy(a)).alias(a) for a in axes))  # a grid: a bounded table
    other = numbered.select(F.col("config").alias("neighbour"), *(F.col(a).alias(f"o_{a}") for a in axes))
    apart: Column = sum((F.abs(F.col(a) - F.col(f"o_{a}")) for a in axes), F.lit(0))
    return numbered.join(other, apart == 1).select("config", "neighbour")


def share_of_peers(results: DataFrame, group: list[str], good: Column, least: int = 3) -> DataFrame:
    """results with peers and peers_share: how many of the others in the group are good; null under `least` others."""
    w = Window.partitionBy(*group)
    n, k = F.count(F.lit(1)).over(w) - 1, F.sum(good.cast("int")).over(w) - good.cast("int")
    return results.withColumn("peers", n).withColumn("peers_share", F.when(n >= least, k / n))
