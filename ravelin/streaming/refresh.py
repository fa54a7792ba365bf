"""A store that streams are appended to, and forward plans whose orders are differences from the sides planned last.

Both write by commits. A commit's rows go to partitions of its own number, then one row of its own goes to the log; readers
see only commits that are in the log. A commit that is run again, in part or whole, replaces what it wrote or changes
nothing, so a lost driver costs one commit's work. Numbers are a stream's batches, which go on over runs, or a plan's bar.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.sources.store import TIMEFRAMES, faults

LATE = "2 hours"
LOG = "instrument string, last timestamp, rows long"
#: What a change of side sends, the least weight that is a side, and the least age at which a bar is stale.
ACTIONS = {(0, 1): ["BUY"], (1, 0): ["SELL"], (0, -1): ["SELL"], (-1, 0): ["BUY"], (1, -1): ["SELL", "SELL"], (-1, 1): ["BUY", "BUY"]}
FLAT, STALE = 1e-12, timedelta(days=4)


def log_of(spark: SparkSession, root: str) -> DataFrame:
    """(instrument, last, rows, commit): what each commit added to each series."""
    try:
        return spark.read.schema(f"{LOG}, commit long").parquet(f"{root}/_log")
    except AnalysisException:  # nothing was committed yet
        return spark.createDataFrame([], f"{LOG}, commit long")


def _committed(spark: SparkSession, root: str, number: int) -> bool:
    return not log_of(spark, root).where(F.col("commit") == number).isEmpty()


def commit(rows: DataFrame, root: str, number: int, *by: str) -> None:
    """Writes rows (instrument, ts, ...), which are the same when computed again, under by / commit, then the log.

    A commit without rows is logged too.
    """
    spark = rows.sparkSession
    numbered = rows.withColumn("commit", F.lit(number).cast("long"))
    (numbered.repartition(*by, "instrument").sortWithinPartitions(*by, "instrument", "ts").write.partitionBy(*by, "commit")
        .option("partitionOverwriteMode", "dynamic").option("compression", "zstd").mode("overwrite").parquet(root))
    wrote = rows.groupBy("instrument").agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("rows"))
    none = spark.createDataFrame([(None, None, 0)], LOG)
    wrote.unionByName(none).coalesce(1).write.mode("overwrite").parquet(f"{root}/_log/commit={number}")  # a row per series touched


def read_committed(spark: SparkSession, root: str, timeframe: str | None = None, before: int | None = None) -> DataFrame | None:
    """Rows of the commits in the log, below a number if one is given; None where nothing is stored."""
    try:
        rows = spark.read.parquet(root)
    except AnalysisException:
        return None
    done = log_of(spark, root).select("commit").distinct()
    if timeframe:
        rows = rows.where(F.col("timeframe") == timeframe)
    if before is not None:
        rows = rows.where(F.col("commit") < before)
    return rows.join(done, "commit", "left_semi")


def append_bars(closed: DataFrame, root: str, number: int, timeframe: str) -> None:
    """Commits the bars that are newer than the end of their stored series; bars that can't be stop the commit."""
    spark = closed.sparkSession
    if timeframe not in TIMEFRAMES:
        raise ValueError(f"a timeframe is one of {TIMEFRAMES}")
    if _committed(spark, root, number):
        return
    end = log_of(spark, root).where("instrument IS NOT NULL").where(F.col("commit") < number).groupBy("instrument").agg(F.max("last").alias("_end"))
    newer = closed.join(end, "instrument", "left").where(F.col("_end").isNull() | (F.col("ts") > F.col("_end"))).drop("_end")
    newer = newer.persist()
    try:
        if bad := faults(newer).collect():  # a row per kind of fault
            raise ValueError(f"bars with faults: {({r.fault: r.n for r in bad})}")
        commit(newer.withColumn("timeframe", F.lit(timeframe)), root, number, "timeframe")
    finally:
        newer.unpersist()


def refresh(closed: DataFrame, root: str, timeframe: str) -> None:
    """Drains a stream of closed bars into the store. State and offsets lie beside it, so the next run goes on from here:
    a bar that was still forming is kept as state and written by the run that sees it close."""
    write = closed.writeStream.foreachBatch(lambda rows, number: append_bars(rows, root, number, timeframe))
    write.outputMode("append").option("checkpointLocation", f"{root}/_state").trigger(availableNow=True).start().awaitTermination()


def actions(old: Column, new: Column) -> Column:
    """What is sent for a change of side."""
    out = F.array().cast("array<string>")
    for (a, b), sent in ACTIONS.items():
        out = F.when((old == a) & (new == b), F.array(*map(F.lit, sent))).otherwise(out)
    return out


def plan(targets: DataFrame, root: str, now: datetime, bar_length: timedelta = timedelta(days=1)) -> DataFrame:
    """(instrument, ts, weight, from_side, to_side, nth, action) that the last bar at or before now asks for, and saves its sides.

    targets: instrument, ts, weight. Sides are those of the plan before (flat for a name it left out); names without a bar
    at the last moment are left out. A bar that is planned already gives no orders. Targets older than two bars and four
    days are refused. Every plan is a commit under the bar's second, so one that is run again doesn't order twice.
    """
    spark = targets.sparkSession
    at = F.lit(now).cast("timestamp")
    last = targets.where(F.col("ts") <= at).agg(F.max("ts").alias("ts"))
    row = last.select(F.unix_seconds("ts").alias("s"), (F.unix_seconds(at) - F.unix_seconds("ts")).alias("age")).first()
    if row.s is None or row.age > max(STALE, 2 * bar_length).total_seconds():
        raise ValueError("the last closed bar is too old for a plan")
    if _committed(spark, root, row.s):
        return read_orders(spark, root).where("false")
    before = log_of(spark, root).where(F.col("commit") < row.s).agg(F.max("commit")).first()[0]
    fresh = targets.where(F.unix_seconds("ts") == row.s).where("weight IS NOT NULL")
    side = F.when(F.abs("weight") > FLAT, F.signum("weight")).otherwise(0).cast("int")
    fresh = fresh.select("instrument", "ts", "weight", side.alias("to_side"))
    if before is None:
        planned = fresh.withColumn("from_side", F.lit(0))
    else:
        had = spark.read.parquet(root).where(F.col("commit") == before).select("instrument", F.col("to_side").alias("from_side"))
        planned = fresh.join(had, "instrument", "left").withColumn("from_side", F.coalesce("from_side", F.lit(0)))
    commit(planned.select("instrument", "ts", "weight", "from_side", "to_side"), root, row.s)
    return read_orders(spark, root).where(F.unix_seconds("ts") == row.s)


def read_orders(spark: SparkSession, root: str) -> DataFrame:
    """Orders of all plans: one row per action, numbered where a reversal sends two."""
    sent = F.posexplode(actions(F.col("from_side"), F.col("to_side"))).alias("nth", "action")
    return read_committed(spark, root).select("instrument", "ts", "weight", "from_side", "to_side", sent)
