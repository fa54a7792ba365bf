"""Packing: shortest-pack-first over the length histogram.

Every document becomes its token ids and a closing id 0. It is cut into full sequences of `size` ids and a rest; the
rest is cut once more, into a multiple of `grain` and what remains, so that the histogram holds short lengths that fill
gaps. The histogram of lengths (at most `size` entries, whatever the input) is packed on the driver: lengths longest
first, each into the shortest pack that takes it, counting how often every pattern occurs. Patterns are then joined back
to the pieces by their rank among the pieces of the same length. Ranks come from counts by (length, salt), so a length
that most pieces share is spread over many tasks.

Defined results: a null or empty text is the closing id alone; a very long text becomes as many full sequences as it fills; rows with
the same id, repeated ones too, are packed separately; pieces of one length are ranked by id, start and row, so ties are settled;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.common import kept_table, parts_of, sliced
from ravelin.llm.tokens import default_vocabulary, ids_of

SIZE, GRAIN = 1024, 64
SALTS, SALT_ROWS = 64, 200_000  # a length's pieces are ranked in so many tasks at least, of so many rows
_PIECES = "rid long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@dataclass(frozen=True)
class Run:
    """Pieces of one length with ranks lo to hi - 1: `each` of them lie side by side at `offset` in every sequence."""

    length: int
    lo: int
    hi: int
    each: int
    offset: int
    sequence: int


def cuts(total: int, size: int, grain: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    full = total // size * size
    out = [(s, size) for s in range(0, full, size)]
    rest = total - full
    for length in (rest // grain * grain, rest % grain):
        if length:
            out.append((total - rest, length))
            rest -= length
    return out


def pack_histogram(counts: dict[int, int], size: int) -> tuple[list[Run], int]:
    """Runs that place every piece of the histogram, and the number of sequences.

    A pack is a list of (length, how many, offset); `open_` maps how full packs are to the packs of that fill and how
    often each occurs. With the lengths falling, the shortest pack takes the next piece; if it doesn't fit there, it
    fits nowhere and new packs are opened, which pieces of the same length then fill.
    """
    open_: dict[int, list[tuple[tuple, int]]] = {0: []}
    for length in sorted((x for x in counts if counts[x]), reverse=True):
        left = counts[length]
        while left:
            fill = min((f for f in open_ if open_[f]), default=size + 1)
            if fill + length > size:
                each = size // length
                for packs, n in ((left // each, each), (1, left % each)):
                    if packs and n:
                        open_.setdefault(n * length, []).append((((length, n, 0),), packs))
                left = 0
                continue
            pack, times = open_[fill].pop()
            used = min(times, left)
            if used < times:
                open_[fill].append((pack, times - used))
            last = pack[-1]
            grown = (*pack[:-1], (length, last[1] + 1, last[2])) if last[0] == length else (*pack, (length, 1, fill))
            open_.setdefault(fill + length, []).append((grown, used))
            left -= used
    runs, rank, sequence = [], dict.fromkeys(counts, 0), 0
    for fill in sorted(open_, reverse=True):
        for pack, times in open_[fill]:
            for length, each, offset in pack:
                runs.append(Run(length, rank[length], rank[length] + each * times, each, offset, sequence))
                rank[length] += each * times
            sequence += times
    return runs, sequence


def _encode(path: str, size: int, grain: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows: list[tuple] = []
            for rid, doc, text in zip(*(b.column(x).to_pylist() for x in ("rid", "doc_id", "text")), strict=True):
                ids = np.append(ids_of(text or "", path), np.uint32(0)).astype("<u4")
                rows += [(rid, doc, s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids)) for s, n in cuts(len(ids), size, grain)]
            if rows:
                names = ["rid", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)

    return encode


def salts_of(n: int) -> int:
    """Into how many tasks the pieces of a length are dealt to be ranked: none ranks many more than SALT_ROWS."""
    return max(SALTS, -(-n // SALT_ROWS))


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, size: int = SIZE, grain: int = GRAIN) -> DataFrame:
    """The pieces that documents are cut into; rid tells rows with one id apart."""
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(_encode(vocabulary or default_vocabulary(), size, grain), _PIECES)


def pack(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, size: int = SIZE, grain: int = GRAIN,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; one row per piece."""
    spark = docs.sparkSession
    cut = kept_table(pieces(docs, id_col=id_col, text_col=text_col, vocabulary=vocabulary, size=size, grain=grain), "pieces")
    sizes = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}  # at most size rows
    many = {length: salts_of(n) for length, n in sizes.items()}
    lengths = F.broadcast(spark.createDataFrame(list(many.items()), "length long, salts int"))
    cut = cut.join(lengths, "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "rid"), F.col("salts")).cast("int")).drop("salts")
    counts = cut.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per salt: SALT_ROWS pieces or more, or one of SALTS
    by = {length: [0] * n for length, n in many.items()}
    for r in counts:
        by[r.length][r.salt] = r.n
    before = [(length, s, first) for length, n in by.items() for s, first in enumerate([0, *accumulate(n)][:-1]) if n[s]]
    runs, _ = pack_histogram(sizes, size)
    offsets = F.broadcast(spark.createDataFrame(before, "length long, salt int, first long"))
    placed = F.broadcast(spark.createDataFrame([tuple(vars(r).values()) for r in runs], "r_length long, lo long, hi long, each long, r_offset long, sequence long"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "rid"))
    ranked = cut.repartition(parts_of(spark), "length", "salt").withColumn("within", within - 1).join(offsets, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("first") + F.col("within"))
    found = ranked.join(placed, (F.col("length") == F.col("r_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return found.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("r_offset") + nth % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )
