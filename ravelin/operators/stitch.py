"""The book of a walk-forward: what the chosen configurations held, one window after another, as one account's trades.

Weights are cut at window edges. A switch turns what the last choice held into what the new one held, name by name, and is
charged to the trades that it closes or opens; a position that a switch keeps on its side runs on as one trade. Names are
partitions throughout; only the calendar of windows and the equity by bar (as long as a record) are ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stitched_book(parts: DataFrame, fold: DataFrame, chosen: DataFrame, rate: float | Column) -> DataFrame:
    """(fold, config, instrument, ts, weight, made, paid, switch) on test windows.

    parts: config, instrument, ts, weight held over the bar, made on it and paid for its own fills, all in shares of the
    equity before the bar. switch: the cost of turning the last choice's weight into the new one's, on a name's first bar
    of the window; rate may be a column of parts (a rate quoted by name and bar). The first window's choice is no switch.
    """
    own = Window.partitionBy("config", "instrument").orderBy("ts")
    p = parts.withColumn("rate", rate if isinstance(rate, Column) else F.lit(rate)).withColumn("before", F.coalesce(F.lag("weight").over(own), F.lit(0.0)))
    turns = fold.join(chosen.select("fold", "config"), "fold", "left").withColumn("last", F.lag("config").over(Window.orderBy("fold")))  # as long as the folds
    turns = turns.select("fold", "config", "last", "test_start", "test_end")
    rows = p.join(F.broadcast(turns), "config").where((F.col("ts") >= F.col("test_start")) & (F.col("ts") < F.col("test_end")))  # the calendar over the step
    nth = F.row_number().over(Window.partitionBy("fold", "instrument").orderBy("ts"))
    left = p.select(F.col("config").alias("last"), "instrument", "ts", F.col("before").alias("left"))
    rows = rows.withColumn("nth", nth).join(left, ["last", "instrument", "ts"], "left")
    turned = (F.col("nth") == 1) & (F.col("last") != F.col("config"))
    switch = F.when(turned, F.abs(F.col("before") - F.coalesce("left", F.lit(0.0))) * F.col("rate")).otherwise(0.0)
    return rows.select("fold", "config", "instrument", "ts", "weight", "made", "paid", switch.alias("switch"))


def record_of(book: DataFrame) -> DataFrame:
    """(ts, r, equity): the book's return by bar, and the equity before it. A return of -1 or less has no record."""
    r = book.groupBy("ts").agg(F.sum(F.col("made") - F.col("paid") - F.col("switch")).alias("r"))
    before = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)  # as long as a record
    return r.withColumn("equity", F.coalesce(F.exp(F.sum(F.log1p("r")).over(before)), F.lit(1.0)))


def ledger(book: DataFrame) -> DataFrame:
    """(instrument, side, entry_time, exit_time, bars, folds, made): the record's trades; made sums to the record's gain.

    made is in units of the first equity. A turn's costs are shared between the trade that it closes and the one that it
    opens, by their weights. Costs of turns that leave a name flat as it was stand in rows of side 0.
    """
    own = Window.partitionBy("instrument").orderBy("ts")
    rows = book.join(record_of(book).select("ts", "equity"), "ts").withColumn("side", F.signum("weight").cast("int"))
    rows = rows.withColumns({"was": F.lag("side").over(own), "held": F.lag(F.abs("weight")).over(own)})
    turned = ~F.col("side").eqNullSafe(F.col("was"))
    rows = rows.withColumn("island", F.sum(turned.cast("int")).over(own))
    cost = F.col("equity") * (F.col("paid") + F.col("switch"))
    closes = F.when(turned, F.coalesce(F.col("held") / F.nullif(F.col("held") + F.abs("weight"), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    here = F.struct(F.col("island"), F.col("ts"), F.col("side"), F.col("fold"), (F.col("equity") * F.col("made") - cost * (1 - closes)).alias("made"))
    none = F.lit(None)
    past = F.struct((F.col("island") - 1).alias("island"), none.cast("timestamp").alias("ts"), none.cast("int").alias("side"), none.cast("int").alias("fold"), (-cost * closes).alias("made"))
    each = rows.select("instrument", F.explode(F.when(closes > 0, F.array(here, past)).otherwise(F.array(here))).alias("x")).select("instrument", "x.*")
    out = each.groupBy("instrument", "island").agg(
        F.max("side").alias("side"), F.min("ts").alias("entry_time"), F.max("ts").alias("exit_time"), F.count("ts").alias("bars"), F.count_distinct("fold").alias("folds"), F.sum("made").alias("made"),
    )
    return out.where("side <> 0 OR abs(made) > 1e-15").drop("island")
