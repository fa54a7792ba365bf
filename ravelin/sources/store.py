"""Stores of bars and results, and readers of vendors' files.

A store is a folder of Parquet partitioned by timeframe and instrument, so a series is found by partition pruning.
"""

from __future__ import annotations

import lzma
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.sources.views import FIELDS

TIMEFRAMES = ("1m", "1h", "4h", "1d")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this session's own where none is set and Spark runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(f"/tmp/checkpoints/{context.applicationId}")
    return context.getCheckpointDir().rstrip("/")


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df written once to the shared folder and read again: what several plans read is made once, and lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/ravelin/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def faults(bars: DataFrame) -> DataFrame:
    """(fault, n): what forbids writing bars. One pass: missing keys or prices, an order of prices that can't be, and moments twice."""
    twice = F.count(F.lit(1)).over(Window.partitionBy("instrument", "ts")) > 1
    fault = (
        F.when(F.col("instrument").isNull() | F.col("ts").isNull(), "no key").when(F.col("close").isNull(), "no close")
        .when((F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")), "range").when(F.col("_twice"), "twice")
    )
    return bars.withColumn("_twice", twice).withColumn("fault", fault).where("fault IS NOT NULL").groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


def write_bars(bars: DataFrame, root: str, timeframe: str) -> None:
    """Writes checked bars; the partitions they touch are replaced."""
    if timeframe not in TIMEFRAMES:
        raise ValueError(f"a timeframe is one of {TIMEFRAMES}")
    if bad := faults(bars).collect():
        raise ValueError(f"bars with faults: {({r.fault: r.n for r in bad})}")
    out = bars.select("instrument", "ts", *FIELDS).withColumn("timeframe", F.lit(timeframe))
    (out.repartition("instrument").sortWithinPartitions("instrument", "ts").write.partitionBy("timeframe", "instrument")
        .option("partitionOverwriteMode", "dynamic").option("compression", "zstd").mode("overwrite").parquet(root))


def read_bars(spark: SparkSession, root: str, timeframe: str, instruments: list[str] | None = None, start: str | None = None, end: str | None = None, columns: list[str] = FIELDS) -> DataFrame:
    """Bars of a timeframe; instruments prune partitions, the span (both ends included) and columns reach the scan."""
    out = spark.read.parquet(root).where(F.col("timeframe") == timeframe)
    if instruments is not None:
        out = out.where(F.col("instrument").isin(instruments))
    if start:
        out = out.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        out = out.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    return out.select("instrument", "ts", *columns)


def quarantine(bars: DataFrame, bad: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, set aside with the reason) by bad(instrument, reason)."""
    return bars.join(bad, "instrument", "left_anti"), bars.join(bad, "instrument")


def encode_series(record: DataFrame) -> DataFrame:
    """(key, first_day, days, r): a daily record as one array; a record with gaps raises."""
    out = record.groupBy("key").agg(F.min("day").alias("first_day"), F.max("day").alias("_last"), F.array_sort(F.collect_list(F.struct("day", "r"))).alias("_x"))
    whole = F.size("_x") == F.datediff("_last", "first_day") + 1
    return out.select("key", "first_day", F.size("_x").alias("days"), F.when(whole, F.col("_x.r")).otherwise(F.raise_error(F.lit("a record has a gap"))).alias("r"))


def decode_series(encoded: DataFrame) -> DataFrame:
    x = encoded.select("key", "first_day", F.posexplode("r").alias("i", "r"))
    return x.select("key", F.timestamp_seconds(F.unix_seconds("first_day") + F.col("i") * 86400).alias("day"), "r")


def klines(rows: DataFrame, column: str = "json") -> DataFrame:
    """Bars from rows [open time in ms, open, high, low, close, volume, close time, quote volume, ...], stamped at their close."""
    x = F.from_json(column, "array<string>")
    at = lambda i: F.element_at("x", i + 1).cast("double")
    return rows.withColumn("x", x).where(F.size("x") >= 8).select(
        "instrument", F.timestamp_millis((at(6) + 1).cast("long")).alias("ts"), at(1).alias("open"), at(2).alias("high"), at(3).alias("low"), at(4).alias("close"), at(5).alias("volume"), at(7).alias("dollar_volume")
    )


def archive_csv(spark: SparkSession, path: str, instrument: str) -> DataFrame:
    """Bars of monthly files with or without a header, stamped in ms or in microseconds."""
    names = ["open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume"]
    raw = spark.read.csv(path, schema=", ".join(f"{n} string" for n in names)).where(F.col("open_time").rlike("^[0-9]+$"))
    t = F.col("close_time").cast("long")
    micros = F.when(t > 10**14, t + 1).otherwise((t + 1) * 1000)
    return raw.select(F.lit(instrument).alias("instrument"), F.timestamp_micros(micros).alias("ts"), *(F.col(n).cast("double").alias(n) for n in names[1:6]), F.col("quote_volume").cast("double").alias("dollar_volume"))


def zoned_csv(spark: SparkSession, path: str, zone: str = "Europe/Berlin") -> DataFrame:
    """One-minute rows (ticker, yyyyMMdd, HHmmss, open, high, low, close) on a zone's clock, as UTC."""
    raw = spark.read.csv(path, schema="ticker string, d string, t string, open double, high double, low double, close double").where(F.col("d").rlike("^[0-9]{8}$"))
    local = F.to_timestamp(F.concat("d", F.lpad("t", 6, "0")), "yyyyMMddHHmmss")
    return raw.select(F.col("ticker").alias("instrument"), F.to_utc_timestamp(local, zone).alias("ts"), "open", "high", "low", "close")


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kind = np.dtype([("s", ">u4"), ("open", ">u4"), ("close", ">u4"), ("low", ">u4"), ("high", ">u4"), ("volume", ">f4")])
    for b in batches:
        for path, start, content in zip(b["path"], b["start"], b["content"], strict=True):
            x = np.frombuffer(lzma.decompress(content), kind)
            out = pd.DataFrame({n: x[n].astype(float) / (1 if n == "volume" else 1e5) for n in ("open", "high", "low", "close", "volume")})
            out.insert(0, "ts", pd.Timestamp(start) + pd.to_timedelta(x["s"].astype("int64"), unit="s"))
            out.insert(0, "path", path)
            yield out


def packed_candles(files: DataFrame) -> DataFrame:
    """Candles of LZMA files: path, start (of the file's span) and content, as of the binaryFile source."""
    return files.select("path", "start", "content").mapInPandas(_decode, "path string, ts timestamp, open double, high double, low double, close double, volume double")


def write_meta(meta: DataFrame, root: str, version: int) -> None:
    """Adds what is known of series: (instrument, timeframe, ...); the highest version of a series counts."""
    meta.withColumn("version", F.lit(version)).coalesce(1).write.mode("append").parquet(root)


def read_meta(spark: SparkSession, root: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("instrument", "timeframe").orderBy(F.desc("version")))
    return spark.read.parquet(root).withColumn("_n", nth).where("_n = 1").drop("_n", "version")


def write_trades(trades: DataFrame, root: str) -> None:
    """Trades by time, in the columnar form's own dictionaries, compressed."""
    trades.sortWithinPartitions("ts").write.option("compression", "zstd").mode("overwrite").parquet(root)


def upsert_results(results: DataFrame, root: str, keys: list[str]) -> None:
    """Adds a run's results as a new generation; readers take the last one of every key, so a run that breaks off changes nothing."""
    spark = results.sparkSession
    have = [p.name for p in _folders(spark, root)]
    number = 1 + max((int(n.split("=")[1]) for n in have if n.startswith("generation=")), default=0)
    results.withColumn("keys", F.array(*(F.col(k).cast("string") for k in keys))).write.parquet(f"{root}/generation={number}")


def _folders(spark: SparkSession, root: str) -> list:
    from types import SimpleNamespace

    jvm = spark._jvm.org.apache.hadoop.fs
    path = jvm.Path(root)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return [SimpleNamespace(name=s.getPath().getName()) for s in fs.listStatus(path)] if fs.exists(path) else []


def read_results(spark: SparkSession, root: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("keys").orderBy(F.desc("generation")))
    return spark.read.parquet(root).withColumn("_n", nth).where("_n = 1").drop("_n", "keys", "generation")


def read_zipped(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table in zip files, unpacked inside tasks, one file at a time."""
    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        with z.open(name) as f:
                            yield pd.DataFrame({"value": f.read().decode().splitlines()[1:]})

    lines = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "value string")
    return lines.select(F.from_csv("value", schema).alias("x")).select("x.*")


def read_market_caps(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot of market values: symbol, name, cap; rows without a value are left out."""
    return spark.read.schema("symbol string, name string, cap double").option("header", True).csv(path).where("cap > 0")
