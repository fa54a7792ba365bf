"""What several corpus operators share: reading, shared-folder tables, hashing of words."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = b" \t\n\r\x0b\x0c"  # fixed values: the bytes \x20 and \x09-\x0D; bytes.split() cuts at just these

#: Rows and bytes of texts that a worker looks at together, but a text is never split. Spark bounds its Arrow batches by bytes itself.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, by Spark's own reader (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset and Spark runs in one process (tests), a folder of this session's own is set; a cluster must name one.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(f"/tmp/checkpoints/{context.applicationId}")
    return context.getCheckpointDir().rstrip("/")


#: Paths of kept tables, each with a weak reference to what Spark's plans read it by.
_kept: dict[str, object] = {}


def kept_table(df: DataFrame, tag: str) -> DataFrame:
    """df written once to the shared folder and read again: lineage ends there and lost executors cost nothing.

    A table belongs to the plans that read it, whoever made them: `sweep` deletes those that no plan can read any more.
    """
    spark = df.sparkSession
    sweep(spark)
    path = f"{shared_dir(spark)}/ravelin/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_path = path
    files = out._jdf.queryExecution().analyzed().relation().location()
    _kept[path] = spark._jvm.java.lang.ref.WeakReference(files)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    _kept.pop(path, None)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def forget(*tables: DataFrame) -> None:
    """Deletes kept tables that their maker knows to be read no more."""
    for t in tables:
        _delete(t.sparkSession, t._kept_path)


def sweep(spark: SparkSession, now: bool = False) -> int:
    """Deletes kept tables that no DataFrame reads any more, and says how many are left.

    Spark clears shuffles and broadcasts in the same way: once their owner is gone from the JVM. now: collect garbage first.
    """
    if now:
        gc.collect()
        spark._jvm.System.gc()
    for path, files in list(_kept.items()):
        if files.get() is None:
            _delete(spark, path)
    return len(_kept)


def row_key(*cols: str | Column) -> Column:
    """128 bits that tell rows apart by their values; equal rows have one key."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(1), *reversed(cols)).alias("b"))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of at most BATCH_ROWS rows and about BATCH_BYTES bytes, without copies."""
    for b in batches:
        step = max(1, min(BATCH_ROWS, b.num_rows * BATCH_BYTES // max(b.nbytes, 1)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salt(*cols: str | Column, n: int) -> Column:
    """A number under n that depends on the columns' values alone, so a task that runs again deals alike."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash: every bit of the input moves every bit of the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash:
    """64-bit hashes of words, remembered up to a bound; the hash never depends on what is remembered."""

    def __init__(self, most: int = 400_000) -> None:
        self.most, self.known = most, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > self.most:
            known.clear()
        out = [known.get(w) for w in words]
        if None in out:
            one = xxhash.xxh3_64_intdigest
            for i, h in enumerate(out):
                if h is None:
                    w = words[i]
                    known[w] = out[i] = one(w)
        return np.array(out, dtype=np.uint64)


def encoded(batch_column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    return [x or b"" for x in batch_column.cast(pa.binary()).to_pylist()]
