"""LM scoring: cross-entropy difference.

Two bigram models share one vocabulary, the ids of a byte-level BPE file: the target model is counted over the target
documents, the background model over all documents, targets included. Both are smoothed alike, by a Dirichlet prior of
`PRIOR` ids drawn from the add-one unigram model. Every token's loss under either model is taken with the token before it
(or the text's start) known; a document's score is the mean of target loss minus background loss, so lower is closer to
the target.

Texts are encoded once. The scan deals documents into blocks of bounded size and counts each block's bigrams, so that a
bigram travels once per block, however many documents hold it: to its sum over all blocks, and with its losses back to
the blocks in which it occurs. There a block's losses lie in memory while its documents, as ids, stream by. The plan is
the same at every size; broadcast are the counts of single ids (at most as many as the vocabulary) and MARKS hashes of target
ids at most, which keep documents that are surely no targets from being shuffled to find the targets' counts.

Defined results: a null or empty text has no tokens and null losses; a very long text may make its block larger by its own
distinct bigrams; rows with one id or equal rows are scored one by one, and each counts; an id given twice as a target
counts once; a row with a null id is never a target; without targets the target model is its prior; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import kept_table, parts_of, sliced
from ravelin.llm.tokens import default_vocabulary, ids_of, vocabulary_size

PRIOR = 20.0
#: Distinct bigrams of a block, about.
HOLD = 1 << 17
#: Target ids are first met by a hash of so many values, whose table is broadcast: its size is bounded, whatever the targets.
MARKS = 1 << 20
_CODED = "block long, doc_id long, n_tokens long, ids binary, key long, n long"


def bigrams(ids: np.ndarray, start: int) -> np.ndarray:
    """Keys of a text's bigrams in order: the id before (start at the text's start) and the id."""
    ids = ids.astype(np.int64)
    return (np.r_[start, ids[:-1]] << 32 | ids) if len(ids) else ids


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each occurs."""
    order = np.argsort(keys)
    k = keys[order]
    head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    n = np.diff(np.r_[head, len(k)]) if counts is None else np.add.reduceat(counts[order], head) if len(k) else head
    return k[head], n.astype(np.int64)


def _code(path: str):
    """Documents as ids, and after those of a block its bigrams."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze, start = zstandard.ZstdCompressor(level=1), vocabulary_size(path)
        kind = np.dtype("<u2") if start <= 1 << 16 else np.dtype("<u4")
        block, keys, counts = TaskContext.get().partitionId() << 32, np.zeros(0, np.int64), np.zeros(0, np.int64)
        names = ["block", "doc_id", "n_tokens", "ids", "key", "n"]

        def grams() -> pa.RecordBatch:
            no = [pa.nulls(len(keys), x) for x in (pa.int64(), pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block)), *no, pa.array(keys), pa.array(counts)], names)

        for b in sliced(batches):
            docs, texts = b.column("doc_id"), b.column("text").to_pylist()
            for at in range(0, len(texts), 500):
                own = [ids_of(t or "", path) for t in texts[at : at + 500]]
                z = pa.array([squeeze.compress(x.astype(kind).tobytes()) for x in own], pa.binary())
                no = pa.nulls(len(own), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), docs.slice(at, len(own)), pa.array([len(x) for x in own], pa.int64()), z, no, no], names)
                k, c = summed(np.concatenate([bigrams(x, start) for x in own]))
                keys, counts = summed(np.r_[keys, k], np.r_[counts, c])
                if len(keys) >= HOLD:
                    yield grams()
                    block, keys, counts = block + 1, keys[:0], counts[:0]
        if len(keys):
            yield grams()

    return code


def _ids(column: pa.Array, start: int) -> Iterator[np.ndarray]:
    import zstandard

    expand, kind = zstandard.ZstdDecompressor(), np.dtype("<u2") if start <= 1 << 16 else np.dtype("<u4")
    for z in column.to_pylist():
        yield np.frombuffer(expand.decompress(z), kind)


def _count(path: str):
    """Bigrams of coded documents, as sums over what a task holds at once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, keys, counts = vocabulary_size(path), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            if len(b):
                k, c = summed(np.concatenate([bigrams(x, start) for x in _ids(b.column("ids"), start)]))
                keys, counts = summed(np.r_[keys, k], np.r_[counts, c])
            if len(keys) >= HOLD:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

    return count


def losses(counts: DataFrame, vocabulary: int) -> DataFrame:
    """(key, target_loss, background_loss) of every bigram that occurs. counts: (key, n, n_target)."""
    counts = counts.withColumns({"h": F.shiftright("key", 32), "w": F.col("key").bitwiseAND(0xFFFFFFFF)})
    before = F.broadcast(counts.groupBy("h").agg(F.sum("n").alias("h_n"), F.sum("n_target").alias("h_t")))  # as many rows as ids, at most
    after = F.broadcast(counts.groupBy("w").agg(F.sum("n").alias("w_n"), F.sum("n_target").alias("w_t")))
    total = counts.agg(F.sum("n").alias("n"), F.sum("n_target").alias("t")).first()

    def loss(pair: str, h: str, w: str, all_: int | None) -> Column:
        one = (F.col(w) + 1) / F.lit(float((all_ or 0) + vocabulary))
        return -F.log((F.col(pair) + F.lit(PRIOR) * one) / (F.col(h) + F.lit(PRIOR)))

    return counts.join(before, "h").join(after, "w").select(
        "key", loss("n_target", "h_t", "w_t", total.t).alias("target_loss"), loss("n", "h_n", "w_n", total.n).alias("background_loss")
    )


def _score(path: str):
    """Over rows sorted by block, with a block's bigrams first, in order of their keys."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, now, model, fresh = vocabulary_size(path), None, [], []
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                g = batch.slice(lo, hi - lo)
                if blocks[lo] != now:
                    now, model, fresh = blocks[lo], [np.zeros(0, np.int64), np.zeros(0), np.zeros(0)], []
                n = len(g) - g.column("key").null_count
                if n:
                    fresh.append([g.column(c)[:n].to_numpy() for c in ("key", "target_loss", "background_loss")])
                if n == len(g):
                    continue
                if fresh:
                    model, fresh = [np.concatenate(x) for x in zip(model, *fresh, strict=True)], []
                out = []
                for ids in _ids(g.column("ids")[n:], start):
                    at = np.searchsorted(model[0], bigrams(ids, start))
                    out.append([float(x[at].mean()) if len(at) else None for x in model[1:]])
                cols = [pa.array(x, pa.float64()) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([g.column("doc_id")[n:], g.column("n_tokens")[n:], *cols], ["doc_id", "n_tokens", "target_loss", "background_loss"])

    return score


def lm_scores(docs: DataFrame, targets: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score. targets: one column, the ids of the target documents."""
    spark, path = docs.sparkSession, vocabulary or default_vocabulary()
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    coded = kept_table(base.mapInArrow(_code(path), _CODED), "coded")
    documents, grams = coded.where("ids IS NOT NULL").select("block", "doc_id", "n_tokens", "ids"), coded.where("key IS NOT NULL").select("block", "key", "n")
    wanted = targets.select(F.col(targets.columns[0]).cast("long").alias("doc_id"))
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS)).alias("mark")
    marked = documents.select("doc_id", "ids", mark).join(F.broadcast(wanted.select(mark).distinct()), "mark", "left_semi")  # few others are left
    chosen = marked.join(wanted, "doc_id", "left_semi")
    of_targets = chosen.select("ids").mapInArrow(_count(path), "key long, n long").select("key", F.lit(0).cast("long").alias("n"), F.col("n").alias("n_target"))
    counts = grams.select("key", "n", F.lit(0).cast("long").alias("n_target")).unionByName(of_targets)
    counts = kept_table(counts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target")), "bigrams")
    model = losses(counts, vocabulary_size(path))
    answers = grams.join(model.hint("merge"), "key").select(
        "block", "key", "target_loss", "background_loss", *(F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("n_tokens", "long"), ("ids", "binary")))
    )
    both = answers.unionByName(documents, allowMissingColumns=True)
    dealt = both.repartition(parts_of(spark), "block").sortWithinPartitions("block", F.asc_nulls_last("key"))
    scored = dealt.mapInArrow(_score(path), "doc_id long, n_tokens long, target_loss double, background_loss double")
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))
