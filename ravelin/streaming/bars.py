"""Streams over events: tumbling bars, sliding medians, sessions, hysteresis positions and a change feed.

A stream is read to its end (availableNow) into a Parquet sink with its checkpoint in the shared folder, so a run that is
cut short goes on where it was, and every window is written once. At the end of a bounded input a mark of a far later time is
read by the same query, so the watermark passes all windows that were open and they are written too.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.sources.store import shared_dir

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LATE = "2 hours"


END = "2200-01-01"


def events(spark: SparkSession, sf_dir: str, marks: str | None = None) -> DataFrame:
    """The events as a stream; marks: a folder of events that mark the input's end."""
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 64)
    single = any(f.endswith("/events.parquet") for f in spark.read.schema(EVENTS).parquet(path).inputFiles()[:1])
    raw = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if single else reader.parquet(path)
    raw = raw.unionByName(spark.readStream.schema(EVENTS).parquet(marks)) if marks else raw
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def _run(stream: DataFrame, root: str) -> None:
    w = stream.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    w.start().awaitTermination()


def drained(stream: DataFrame) -> DataFrame:
    """What a stream without windows has written when its input is at an end."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    _run(stream, root)
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def whole(spark: SparkSession, sf_dir: str, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All windows of a bounded input: those closed on the way, then, past the mark of its end, those still open."""
    root = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    mark = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(END).cast("timestamp_ntz").alias("ts"), *(F.lit(None).cast(t).alias(c) for c, t in (("user_id", "long"), ("event_type", "string"), ("value", "double"), ("props", "string"))))
    mark.limit(0).write.parquet(f"{root}/marks")
    for _ in range(2):
        stream = plan(events(spark, sf_dir, f"{root}/marks"))
        _run(stream, root)
        mark.write.mode("append").parquet(f"{root}/marks")
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def hourly_bars(stream: DataFrame) -> DataFrame:
    o = F.struct("ts", "event_id")
    b = stream.groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("instrument")).agg(
        F.min_by("value", o).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", o).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )
    return b.select("instrument", F.col("w.end").alias("ts"), "open", "high", "low", "close", "volume")


def sliding_volume(stream: DataFrame, length: str = "24 hours", step: str = "6 hours") -> DataFrame:
    b = stream.groupBy(F.window("ts", length, step).alias("w"), F.col("event_type").alias("instrument")).agg(F.count(F.lit(1)).alias("n"), F.expr("percentile(value, 0.5D)").alias("median"))
    return b.select("instrument", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "median")


def sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    b = stream.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return b.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")


def _position(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    (held,) = state.get if state.exists else (0.0,)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
    out = []
    for ts, i, v in zip(rows["ts"], rows["event_id"], rows["value"], strict=True):
        new = 1.0 if v < 20 else 0.0 if v > 80 else held
        if new != held:
            held = new
            out.append((key[0], ts, i, held))
    state.update((held,))
    yield pd.DataFrame(out, columns=["instrument", "ts", "event_id", "position"])


def positions(stream: DataFrame) -> DataFrame:
    """Changes of a position that is taken under 20 and left over 80, one state per instrument."""
    return stream.select(F.col("event_type").alias("instrument"), "ts", "event_id", "value").groupBy("instrument").applyInPandasWithState(
        _position, "instrument string, ts timestamp, event_id long, position double", "held double", "append", "NoTimeout"
    )


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes by kind and batch; a batch that is run again replaces what it wrote."""
    root = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        kinds = batch.groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))
        kinds.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    stream = events(spark, sf_dir).writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    stream.start().awaitTermination()
    return spark.read.parquet(f"{root}/out")
