"""Exact top-k search by aggregation without random access.

Score of a row for a query: the inner product of integer vectors. Rows are dealt into shards of bounded size, once; the
stated queries go to every shard and are streamed through it, so neither side is held whole and rows are never copied.

In a shard, rows lie in blocks, and every component of a block is a list of its rows in order of their values. A query
reads all lists from the end where its contributions are largest. What a list gave last bounds what its unread rows can
give: a row's upper bound is the sum of what was read of it and of these bounds for the rest, and a row that no list has
given yet has the bounds alone. The k-th best score so far is carried from block to block; reading stops when rows that
were not read cannot reach it and few of the read ones can. Final scores are resolved for those alone. The first block of
a shard is small and read to its end, so that later ones have a score to beat. Per query and shard k rows leave.

Defined results: null vectors and those with a null, NaN or infinite component take no part, nor do rows with a null id;
finite components of any size do. A shorter vector has zeros beyond its end; equal rows count once; an id with several
vectors takes part with each; ties go to the smaller id; fewer candidates give fewer rows; an empty table gives an empty
result; other columns are ignored. Scores are exact: where sums could pass 2**53, bounds allow for rounding and final scores are
taken in whole numbers of any size; a score among
the k best of a shard that is no 64-bit integer raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.common import kept_table, parts_of

SCALE = 256
#: Rows of a shard at most on average, of a shard at least where there are few rows, of a block, and of a shard's first block.
SHARD, LEAST_SHARD, BLOCK, FIRST = 1 << 16, 2048, 8192, 512
#: Shares of a block's lists that are read before bounds are looked at.
DEPTHS = (0.06, 0.2, 0.45)
#: Reading stops once at most this share of a block can still qualify.
FEW = 0.02
#: Sums of doubles that hold whole numbers are exact below.
EXACT = 2.0**53


def quantised(column: str, scale: int = SCALE) -> Column:
    """Whole numbers, as doubles: those of 2**53 and more are whole already."""

    def one(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)

    return F.transform(F.col(column), one)


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): distinct rows that take part."""
    good = F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))  # NaN is more than any number
    ok = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(F.coalesce(good, F.lit(False)))
    return ok.select(F.col(id_col).cast("long").alias("vec_id"), quantised(vector_col, scale).alias("v")).dropDuplicates()


def _matrix(column: pa.ChunkedArray | pa.Array, wide: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    out, at = np.zeros((len(column), wide)), 0
    for chunk in chunks:
        flat, ends = chunk.flatten().to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        ends = ends - ends[0]
        size = np.diff(ends)
        if len(size) and (size == wide).all():
            out[at : at + len(size)] = flat.reshape(-1, wide)
        else:
            for i, n in enumerate(size):
                out[at + i, :n] = flat[ends[i] : ends[i] + n]
        at += len(size)
    if not np.isfinite(out).all():
        raise ValueError("a component is too large to be scaled")
    return out


class Block:
    """A block's rows, and for every component the rows and values from the smallest (0) and from the largest (1)."""

    def __init__(self, ids: np.ndarray, v: np.ndarray) -> None:
        self.ids, self.v, self.largest = ids, v, float(np.abs(v).max(initial=0))
        order = np.argsort(v, axis=0, kind="stable").T
        value = np.take_along_axis(v.T, order, axis=1)
        self.rows, self.values = (np.ascontiguousarray(np.stack([x, x[:, ::-1]])) for x in (order, value))

    def candidates(self, q: np.ndarray, kth: float, slack: float, start: int = 0) -> tuple[np.ndarray, int]:
        """Rows that can reach kth, by reading the lists as far as is needed to know, and which depth that was.

        start: the first of DEPTHS at which bounds are looked at.
        """
        n, used = len(self.ids), np.flatnonzero(q)
        if kth == -np.inf or slack == np.inf or not len(used):
            return np.arange(n), start
        ends, left, at = (q[used] > 0).astype(np.intp), np.arange(n), start
        for at in range(start, len(DEPTHS)):
            depth = max(1, int(n * DEPTHS[at]))
            last = self.values[ends, used, depth - 1]
            unread = float(q[used] @ last)
            read = self.rows[ends, used, :depth]
            more = (self.values[ends, used, :depth] - last[:, None]) * q[used][:, None]
            upper = np.bincount(read.ravel(), weights=more.ravel(), minlength=n) + unread  # 0 more where a row was not read
            left = np.flatnonzero(upper >= kth - slack)
            if len(left) <= FEW * n:
                break
        return left, at


def _exact(rows: np.ndarray, q: np.ndarray, bound: float) -> np.ndarray:
    """Inner products as whole numbers, in the narrowest kind that holds them."""
    if bound < EXACT:
        return (rows @ q).astype(np.int64)
    if bound < 2.0**62:
        return rows.astype(np.int64) @ q.astype(np.int64)
    whole = [int(x) for x in q]
    return np.array([sum(int(x) * y for x, y in zip(r, whole, strict=True)) for r in rows.tolist()], dtype=object)


def top_of_shard(blocks: list[Block], own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best rows of a shard for a query, best first, ties in order of id."""
    ids, best, kth, depth = np.zeros(0, np.int64), np.zeros(0, np.int64), -np.inf, 0
    length = float(np.abs(q).sum())
    for b in blocks:
        bound = length * b.largest
        slack = 0.0 if bound < EXACT / 4 else bound * len(q) * 2.0**-48 if bound < 2.0**900 else np.inf
        at, depth = b.candidates(q, kth, slack, depth)  # as deep as the last block needed, at once
        at = at[b.ids[at] != own]
        score = _exact(b.v[at], q, bound)
        ids, best = np.r_[ids, b.ids[at]], np.r_[best, score]
        if len(best) > k:
            if best.dtype == object:
                first = np.array(sorted(range(len(best)), key=lambda i: (-best[i], ids[i]))[:k])
            else:
                edge = np.partition(best, len(best) - k)[len(best) - k]
                first = np.flatnonzero(best >= edge)
                first = first[np.lexsort((ids[first], -best[first]))][:k]
            ids, best = ids[first], best[first]
        if len(best) == k:
            least = int(min(_longs(best)))
            kth = float(least) - (2048 if abs(least) >= EXACT else 0)  # a long is off by at most 1024 as a double
    return ids, best


def _longs(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object and any(not -(2**63) <= x < 2**63 for x in scores):
        raise OverflowError("a score is no 64-bit integer")
    return scores.astype(np.int64)


def _search(k: int, wide: int):
    """Over (shard, query, vec_id, v), sorted by shard and with its rows (no query) first."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, parts, blocks = None, [], [], []
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                g = batch.slice(lo, hi - lo)
                if shards[lo] != now:
                    now, ids, parts, blocks = shards[lo], [], [], []
                n = g.column("query").null_count
                if n:
                    ids, parts = [*ids, g.column("vec_id")[:n].to_numpy()], [*parts, _matrix(g.column("v")[:n], wide)]
                if n == len(g):
                    continue
                if parts and not blocks:
                    every, v = np.concatenate(ids), np.concatenate(parts)
                    cut = [0, *range(FIRST, len(every), BLOCK), len(every)]
                    blocks = [Block(every[a:z], v[a:z]) for a, z in zip(cut, cut[1:], strict=False) if a < z]
                    ids, parts = [], []
                key, own, q = g.column("query")[n:].to_numpy(), g.column("vec_id")[n:].to_numpy(), _matrix(g.column("v")[n:], wide)
                found = [top_of_shard(blocks, own[i], q[i], k) for i in range(len(q))]
                many = [len(x) for x, _ in found]
                cols = np.repeat(key, many), np.repeat(own, many), np.concatenate([x for x, _ in found]), np.concatenate([_longs(s) for _, s in found])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["query", "query_id", "vec_id", "score"])

    return search


def top_k(rows: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each query, a row with the query's own id left out."""
    parts = parts_of(rows.sparkSession)
    v = kept_table(whole_vectors(rows, id_col, vector_col, scale), "vectors")
    q = kept_table(whole_vectors(queries, id_col, vector_col, scale).withColumn("query", F.monotonically_increasing_id()), "queries")
    size = v.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("wide")).first()
    shards = max(-(-size.n // SHARD), min(4 * parts, -(-size.n // LEAST_SHARD)), 1)
    wide = max(size.wide or 0, q.agg(F.max(F.size("v"))).first()[0] or 0)
    left = v.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), F.lit(None).cast("long").alias("query"), "vec_id", "v")
    right = q.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "query", "vec_id", "v")
    dealt = left.unionByName(right).repartition(max(shards, parts), "shard").sortWithinPartitions("shard", F.asc_nulls_first("query"))
    best = dealt.mapInArrow(_search(k, wide), "query long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
