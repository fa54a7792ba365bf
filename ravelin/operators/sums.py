"""Sums of doubles that don't depend on order or partitioning: no bit is lost before the end.

A double is a whole number times a power of two. Whole numbers of one power add up exactly as decimals, so the partial sums
by power merge in any order, as any aggregate does; the powers (a few dozen for prices) are put together last, from the
greatest down, with the error of each addition carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _scaled(x: Column, power: Column) -> Column:
    """x times two to a power, exactly: in two steps, so that no step overflows."""
    half = F.floor(power / 2)
    return x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half)


def exact_sum(df: DataFrame, keys: list[str], value: str, out: str = "total") -> DataFrame:
    """(keys, out): the sum of a column by keys, nulls left out; null without values. NaN and infinities sum as usual."""
    x = F.col(value).cast("double")
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    power = F.when(odd | (x == 0), 0).otherwise(F.greatest(F.floor(F.log2(F.abs(x))) - 53, F.lit(-1074)))
    rows = df.select(*keys, x.alias("_x"), odd.alias("_odd"), power.cast("int").alias("_power")).where("_x IS NOT NULL")
    whole = F.when(~F.col("_odd"), _scaled(F.col("_x"), -F.col("_power"))).otherwise(0.0).cast("decimal(20,0)")
    by_power = rows.groupBy(*keys, "_power").agg(F.sum(whole).cast("decimal(38,0)").alias("_n"), F.sum(F.when(F.col("_odd"), F.col("_x"))).alias("_o"))
    gathered = by_power.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_power", "_n")), asc=False).alias("_parts"), F.sum("_o").alias("_o"))  # as many as powers

    def carried(state: Column, part: Column) -> Column:
        """An addition with its error (two-sum), of the high half of a part and then of its low one."""
        for half in halves(part):
            s = state["s"] + half
            back = s - state["s"]
            state = F.struct(s.alias("s"), (state["c"] + ((state["s"] - (s - back)) + (half - back))).alias("c"))
        return state

    def halves(part: Column) -> list[Column]:
        """A decimal as two doubles that add up to it exactly, up to 2 ** 104."""
        cut = F.lit(2**52).cast("decimal(20,0)")
        high = F.call_function("div", part["_n"], cut)
        low = part["_n"] - (high.cast("decimal(20,0)") * cut).cast("decimal(38,0)")
        return [_scaled(high.cast("double"), part["_power"] + 52), _scaled(low.cast("double"), part["_power"])]

    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))
    total = F.aggregate("_parts", zero, carried, lambda s: s["s"] + s["c"])
    return gathered.select(*keys, F.coalesce(F.col("_o"), total).alias(out))
