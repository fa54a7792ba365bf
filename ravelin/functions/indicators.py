"""Indicators as window expressions over bars.

All are causal: a value at a bar uses that bar and earlier ones. A value is null until its window is full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def own() -> Window:
    return Window.partitionBy("instrument").orderBy("ts")


def rows(n: int, to: int = 0) -> Window:
    """The n bars up to `to` bars ago."""
    return own().rowsBetween(-(n - 1) - to, -to)


def full(value: Column, counted: Column | str, n: int, over: Window) -> Column:
    return F.when(F.count(counted).over(over) == n, value)


def sma(c: Column | str, n: int) -> Column:
    return full(F.avg(c).over(rows(n)), c, n, rows(n))


SAME = 1e-12  # fixed value: averages no further apart than this share of the slow one are equal, for sums of doubles are no closer


def cross(fast: Column | str, slow: Column | str) -> Column:
    """The side of one average against another: 1, -1, or 0 where they differ by rounding only."""
    fast, slow = (F.col(c) if isinstance(c, str) else c for c in (fast, slow))
    return F.when(F.abs(fast - slow) <= SAME * F.abs(slow), 0.0).otherwise(F.signum(fast - slow))


def bollinger(c: Column | str, n: int, k: float) -> tuple[Column, Column, Column]:
    """Lower, middle and upper band; the deviation is the population's."""
    middle, dev = F.avg(c).over(rows(n)), F.stddev_pop(c).over(rows(n))
    return tuple(full(x, c, n, rows(n)) for x in (middle - k * dev, middle, middle + k * dev))


def roc(c: str, n: int) -> Column:
    return F.col(c) / F.lag(c, n).over(own()) - 1


def ibs() -> Column:
    """Where the close lies in the bar's range; null for a bar without range."""
    return (F.col("close") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))


def donchian(n: int) -> tuple[Column, Column]:
    """Greatest high and least low of the n bars before."""
    w = rows(n, 1)
    return full(F.max("high").over(w), "high", n, w), full(F.min("low").over(w), "low", n, w)


def log_return(c: str = "close") -> Column:
    return F.log(F.col(c) / F.lag(c).over(own()))


def realized_vol(r: str, n: int) -> Column:
    return full(F.stddev_samp(r).over(rows(n)), r, n, rows(n))


def true_range() -> Column:
    before = F.lag("close").over(own())
    return F.when(before.isNull(), F.col("high") - F.col("low")).otherwise(F.greatest("high", before) - F.least("low", before))


def stochastic(n: int, smooth: int, d: int) -> Callable[[DataFrame], DataFrame]:
    """slow_k and slow_d."""

    def add(bars: DataFrame) -> DataFrame:
        lo, hi = F.min("low").over(rows(n)), F.max("high").over(rows(n))
        k = F.when(hi == lo, 0.0).otherwise(100 * (F.col("close") - lo) / (hi - lo))
        return bars.withColumn("fast_k", full(k, "close", n, rows(n))).withColumn("slow_k", sma("fast_k", smooth)).withColumn("slow_d", sma("slow_k", d))

    return add


def williams_r(n: int) -> Column:
    lo, hi = F.min("low").over(rows(n)), F.max("high").over(rows(n))
    return full(F.when(hi == lo, 0.0).otherwise(-100 * (hi - F.col("close")) / (hi - lo)), "close", n, rows(n))


def obv() -> Column:
    """Volume so far, counted up or down with the close; the first bar's volume counts up."""
    before = F.lag("close").over(own())
    signed = F.when(before.isNull(), F.col("volume")).otherwise(F.signum(F.col("close") - before) * F.col("volume"))
    return signed


def money_flow(n: int) -> Callable[[DataFrame], DataFrame]:
    def add(bars: DataFrame) -> DataFrame:
        typical = (F.col("high") + F.col("low") + F.col("close")) / 3
        step = bars.withColumn("typical", typical).withColumn("move", F.col("typical") - F.lag("typical").over(own())).withColumn("flow", F.col("typical") * F.col("volume"))
        step = step.withColumn("up", F.when(F.col("move") > 0, F.col("flow")).when(F.col("move").isNotNull(), 0.0)).withColumn("down", F.when(F.col("move") < 0, F.col("flow")).when(F.col("move").isNotNull(), 0.0))
        up, down = F.sum("up").over(rows(n)), F.sum("down").over(rows(n))
        return step.withColumn("mfi", full(F.when(up + down < 1, 0.0).otherwise(100 * up / (up + down)), "up", n, rows(n)))

    return add


def momentum(c: str, n: int) -> Column:
    return F.col(c) - F.lag(c, n).over(own())


def wma(c: str, n: int) -> Column:
    """Mean with weights that rise by one from the oldest bar to this one."""
    return sum((F.lag(c, i).over(own()) * (n - i) for i in range(1, n)), F.col(c) * n) / (n * (n + 1) / 2)


def cci(n: int) -> Callable[[DataFrame], DataFrame]:
    """The typical price's distance from its mean in mean absolute deviations, by 0.015."""

    def add(bars: DataFrame) -> DataFrame:
        b = bars.withColumn("typical", (F.col("high") + F.col("low") + F.col("close")) / 3).withColumn("_m", sma("typical", n)).withColumn("_l", F.collect_list("typical").over(rows(n)))
        dev = F.aggregate("_l", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_m"))) / n
        return b.withColumn("cci", F.when(F.col("_m").isNotNull(), F.coalesce((F.col("typical") - F.col("_m")) / (0.015 * F.nullif(dev, F.lit(0.0))), F.lit(0.0)))).drop("_m", "_l")

    return add


def aroon(n: int) -> Callable[[DataFrame], DataFrame]:
    """How lately the greatest high and the least low of n + 1 bars were, in percent of n; the latest of equal ones counts."""

    def add(bars: DataFrame) -> DataFrame:
        b = bars.withColumn("_i", F.row_number().over(own()))
        w = rows(n + 1)
        last = lambda f, key: f(F.struct(key, "_i")).over(w)["_i"]
        up, down = last(F.max, F.col("high")), last(F.max, (-F.col("low")).alias("k"))
        return b.withColumns({"aroon_up": full(100.0 * (n - (F.col("_i") - up)) / n, "high", n + 1, w), "aroon_down": full(100.0 * (n - (F.col("_i") - down)) / n, "low", n + 1, w)}).drop("_i")

    return add


def slope(c: str, n: int) -> Callable[[DataFrame], DataFrame]:
    """Of the least-squares line through the last n bars, per bar."""

    def add(bars: DataFrame) -> DataFrame:
        b = bars.withColumn("_x", F.row_number().over(own()).cast("double"))
        return b.withColumn("linearreg_slope", full(F.regr_slope(c, "_x").over(rows(n)), c, n, rows(n))).drop("_x")

    return add


#: Indicators by name: functions of a DataFrame of bars and a period.
LIBRARY: dict[str, Callable[[DataFrame, int], DataFrame]] = {
    "sma": lambda b, n: b.withColumn("sma", sma("close", n)),
    "roc": lambda b, n: b.withColumn("roc", roc("close", n)),
    "mom": lambda b, n: b.withColumn("mom", momentum("close", n)),
    "wma": lambda b, n: b.withColumn("wma", full(wma("close", n), "close", n, rows(n))),
    "willr": lambda b, n: b.withColumn("willr", williams_r(n)),
    "cci": lambda b, n: cci(n)(b),
    "aroon": lambda b, n: aroon(n)(b),
    "mfi": lambda b, n: money_flow(n)(b),
    "linearreg_slope": lambda b, n: slope("close", n)(b),
    "stddev": lambda b, n: b.withColumn("stddev", full(F.stddev_pop("close").over(rows(n)), "close", n, rows(n))),
    "midpoint": lambda b, n: b.withColumn("midpoint", full((F.max("close").over(rows(n)) + F.min("close").over(rows(n))) / 2, "close", n, rows(n))),
}


def call(bars: DataFrame, name: str, n: int) -> DataFrame:
    """bars with an indicator by its name."""
    if name not in LIBRARY:
        raise ValueError(f"no indicator {name}: {', '.join(LIBRARY)}")
    return LIBRARY[name](bars, n)
