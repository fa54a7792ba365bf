"""State machines over bars as window expressions: hysteresis, confirmation, runs and rebalancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.operators.panel import own, runs_of


def hold_between(enter: Column, leave: Column) -> Column:
    """1 from enter until leave, enter first where both hold; 0 before."""
    return F.coalesce(F.last(F.when(enter, 1.0).when(leave, 0.0), ignorenulls=True).over(own()), F.lit(0.0))


def with_short(long: Column, short: Column, long_only: bool) -> Column:
    return long if long_only else long - short


def confirmed(df: DataFrame, state: str, k: int, out: str = "confirmed") -> DataFrame:
    """The last state that held k bars in a row; null before the first."""
    marked = runs_of(df, state)
    taken = F.last(F.when(F.col("nth") >= k, F.col(state)), ignorenulls=True).over(own())
    return marked.withColumn(out, taken).drop("island", "nth")


def after_runs(df: DataFrame, side: str, k_in: int, k_out: int, out: str = "position") -> DataFrame:
    """1 after k_in bars with side in a row, 0 after k_out without."""
    marked = runs_of(df, side)
    event = F.when(F.col(side) & (F.col("nth") >= k_in), 1.0).when(~F.col(side) & (F.col("nth") >= k_out), 0.0)
    return marked.withColumn(out, F.coalesce(F.last(event, ignorenulls=True).over(own()), F.lit(0.0))).drop("island", "nth")


def vol_state(value: str, ref: int, least: int) -> Column:
    """0, 1 or 2: the third of its last `ref` values that a value ranks in (mean rank of ties); null under `least` values."""
    w = own().rowsBetween(-(ref - 1), 0)
    seen = F.collect_list(value).over(w)
    under, equal = F.size(F.filter(seen, lambda x: x < F.col(value))), F.size(F.filter(seen, lambda x: x == F.col(value)))
    rank = (under + (equal + 1) / 2) / F.size(seen)
    return F.when(F.col(value).isNotNull() & (F.count(value).over(w) >= least), F.when(rank <= 1 / 3, 0).when(rank <= 2 / 3, 1).otherwise(2))


def rebalanced(weight: str, start: Column) -> Column:
    """Decisions on period starts only, held until the next; 0 before."""
    return F.coalesce(F.last(F.when(start, F.coalesce(weight, F.lit(0.0))), ignorenulls=True).over(own()), F.lit(0.0))


def age(df: DataFrame, side: str) -> DataFrame:
    return runs_of(df, side).withColumnRenamed("nth", "age").drop("island")


def spans(df: DataFrame, weight: str) -> DataFrame:
    """(instrument, side, start, end, bars): runs of one sign; null counts as 0."""
    signed = df.withColumn("side", F.coalesce(F.signum(weight), F.lit(0.0)).cast("int"))
    out = runs_of(signed, "side").where("side <> 0").groupBy("instrument", "island", "side")
    return out.agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("bars")).drop("island")


# Across instruments at one moment.


def at(*order: Column) -> Window:
    return Window.partitionBy("ts").orderBy(*order)


def ends(df: DataFrame, score: str, frac: float) -> DataFrame:
    """side: 1 for the k greatest scores of a moment, -1 for the k least; k is the share, at least 1, at most half. Ties by name."""
    ok = df.where(F.col(score).isNotNull())
    n = F.count(F.lit(1)).over(Window.partitionBy("ts"))
    k = F.least(F.greatest(F.floor(n * frac), F.lit(1)), n / 2)
    ranked = ok.withColumn("n_names", n).withColumn("k", k).withColumn("rank", F.row_number().over(at(F.col(score), F.col("instrument"))))
    side = F.when(F.col("rank") <= F.floor("k"), -1).when(F.col("rank") > F.col("n_names") - F.floor("k"), 1).otherwise(0)
    return ranked.withColumn("side", side)


def long_short(df: DataFrame, score: str, frac: float, least: int = 6) -> DataFrame:
    """weight: half of the equity over each end, flat at moments with fewer than `least` names."""
    e = ends(df, score, frac)
    weight = F.when((F.col("n_names") < least) | (F.col("side") == 0), 0.0).otherwise(0.5 * F.col("side") / F.floor("k"))
    return e.withColumn("weight", weight)


def top_k(df: DataFrame, score: str, k: int, over: Column | None = None) -> DataFrame:
    """weight 1 / k for the k greatest scores of a moment; `over`: scores must exceed it."""
    nth = F.row_number().over(at(F.desc_nulls_last(score), F.col("instrument")))
    good = F.col(score).isNotNull() if over is None else F.coalesce(F.col(score) > over, F.lit(False))
    return df.withColumn("rank", nth).withColumn("weight", F.when((F.col("rank") <= k) & good, 1.0 / k).otherwise(0.0))


def liquidity(bars: DataFrame, days: int) -> DataFrame:
    """Median daily money over the last days, missed days as 0, seasoned half the span, known a day later.

    bars are daily and on the grid of days."""
    filled = bars.withColumn("_money", F.coalesce("dollar_volume", F.lit(0.0))).withColumn("_age", F.count("close").over(own()))
    median = F.when(F.col("_age") >= days // 2, F.expr(f"percentile(_money, 0.5D) OVER (PARTITION BY instrument ORDER BY ts ROWS BETWEEN {days - 1} PRECEDING AND CURRENT ROW)"))
    return filled.withColumn("_median", median).withColumn("liquidity", F.lag("_median").over(own())).drop("_money", "_age", "_median")


def rolling_beta(value: str, market: str, n: int) -> Column:
    w = own().rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(w) == n, F.covar_samp(value, market).over(w) / F.nullif(F.var_samp(market).over(w), F.lit(0.0)))
