"""MinHash near-dedup: an inverted join over signature coordinates.

A document's set is its distinct 5-word shingles (A-Z lower-cased; fewer words: the whole sequence is one shingle).
Documents with equal sets form a class, and one of each class goes on. Its signature has `COORDS` coordinates. A pair is
a candidate if at least `matches` coordinates agree, a number set by the wanted similarity: a pair just at 0.85 falls
short of the 16 with probability 6e-7, one at 0.80 of the 13 with 2e-7.

*Prefix merging.* Coordinate-value pairs are ordered by how many classes hold them, rarest first. Two classes that
agree in `matches` coordinates share one within their first COORDS - matches + 1, so only those are posted; values of a
passage that many documents share come late and are mostly never posted.

*Skip merging.* In each posting list all members are first tried against the list's smallest only, and confirmed links
are joined into components. A list whose members are then in one component is skipped as a whole. In what remains, only
pairs between different components are counted, in blocks of bounded size, with a longer signature (`FINE` coordinates;
a true pair falls short with a probability of about 1e-7), and all lists that hold a pair but the first skip it.

Every candidate is confirmed on the full sets of both documents. No list is cut and no pair is left out; copies are never
expanded into pairs.

Defined results: very long texts are shingled whole, at about 8 bytes a shingle; ties for a class or a component go to the smallest id; null, empty or blank texts have an empty set and are linked with nothing; rows with one id are separate
members of the class of their text; a null id never becomes a component's id unless all of it are null; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.common import encoded, forget, kept_table, mix, sliced, WordHash
from ravelin.llm.components import components, relabelled
from ravelin.llm.runs import runs

WORDS = 5
COORDS, FINE, FIRST = 32, 2048, 64  # the first of the fine ones are compared before the others
BLOCK = 700
#: Links are pairs with 100 * |intersection| >= PERCENT * |union|.
PERCENT = 85
#: At most so probable is it that a pair just at the wanted similarity has too few equal coordinates: of COORDS, FINE and FIRST.
MISS, FINE_MISS, FIRST_MISS = 1e-6, 1.1e-7, 1e-9

_WORD = WordHash()


def least_matches(n: int, p: float, miss: float) -> int:
    """The largest m so that fewer than m of n coordinates, each equal with probability p, agree with a probability of miss at most."""
    if p >= 1:
        return n
    total = 0.0
    for m in range(n + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(m + 1) - math.lgamma(n - m + 1) + m * math.log(p) + (n - m) * math.log1p(-p))
        if total > miss:
            return m
    return n


@lru_cache(maxsize=8)
def thresholds(percent: int) -> tuple[int, int, int]:
    """How many of COORDS, FINE and FIRST coordinates a pair must have in common; one byte of the fine ones is compared."""
    p = percent / 100
    byte = p + (1 - p) / 256
    return least_matches(COORDS, p, MISS), least_matches(FINE, byte, FINE_MISS), least_matches(FIRST, byte, FIRST_MISS)


@lru_cache(maxsize=8)
def _family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


@lru_cache(maxsize=4)
def _places(n: int) -> np.ndarray:
    return np.random.default_rng(5).integers(0, 2**63, n, dtype=np.uint64) | np.uint64(1)


def shingles(data: bytes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h, c = _WORD(words), _places(n + 1)
    if len(h) < n:  # one shingle; its length enters so that it equals no longer one
        return mix((h * c[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    m = len(h) - n + 1
    total = h[:m] * c[0]
    for i in range(1, n):
        total += h[i : i + m] * c[i]
    return np.unique(mix(total))


def signature(s: np.ndarray, n: int, seed: int) -> np.ndarray:
    a, b = _family(n, seed)
    x = (s >> np.uint64(32)).astype(np.uint32)
    step = max(1, 2_000_000 // n)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), step):
        h = np.multiply.outer(a, x[at : at + step])
        h += b[:, None]
        np.minimum(out, h.min(axis=1), out=out)
    return out


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * |both| >= percent * |either|."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate((x, y)), kind="stable")  # merges two sorted runs
    n = int((both[1:] == both[:-1]).sum())
    return 100 * n >= percent * (len(x) + len(y) - n)


_SETS = "rid long, doc_id long, n long, digest binary, coords array<long>, z binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1)
    place = np.arange(COORDS, dtype=np.int64) << 32
    for b in sliced(batches):
        n, digest, coords, z = [], [], [], []
        for data in encoded(b.column("text")):
            s = shingles(data)
            n.append(len(s))
            digest.append(xxhash.xxh3_128_digest(s.tobytes()))
            coords.append(signature(s, COORDS, 11).astype(np.int64) + place if len(s) else [])
            z.append(squeeze.compress(data) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [b.column("rid"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(coords, pa.list_(pa.int64())), pa.array(z, pa.binary())],
            ["rid", "doc_id", "n", "digest", "coords", "z"],
        )


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    expand = zstandard.ZstdDecompressor()
    for b in sliced(batches):
        sig = [signature(shingles(expand.decompress(z)), FINE, 13).astype(np.uint8).tobytes() for z in b.column("z").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array(sig, pa.binary())], ["cid", "sig"])


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor()
        known: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(i: int, z: bytes) -> np.ndarray:
            if i in known:
                known.move_to_end(i)
            else:
                known[i] = shingles(expand.decompress(z))
                if len(known) > 500:
                    known.popitem(last=False)
            return known[i]

        for batch in batches:
            a, b, za, zb = (batch.column(x).to_pylist() for x in ("a", "b", "za", "zb"))
            good = [similar(of(a[i], za[i]), of(b[i], zb[i]), percent) for i in range(len(a))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return confirm


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b), those that are linked by their full sets. texts: (cid, z)."""
    needed = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    texts = kept_table(texts.join(needed, "cid", "left_semi"), "texts")
    with_b = pairs.join(texts.withColumnsRenamed({"cid": "b", "z": "zb"}), "b")
    with_both = with_b.join(texts.withColumnsRenamed({"cid": "a", "z": "za"}), "a").select("a", "b", "za", "zb")
    out = kept_table(with_both.mapInArrow(_confirm(percent), "a long, b long"), "confirmed")
    forget(texts)
    return out


def _between(percent: int):
    """Pairs between different labels of one block pair, by the longer signature and the sizes."""
    _, fine, first = thresholds(percent)

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for (key, i, j), g in runs(batches, ["key", "i", "j"]):
            cid, label, n, block = (g.column(x).to_numpy() for x in ("cid", "label", "n", "block"))
            sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), np.uint8).reshape(len(cid), FINE)
            posted = np.full((len(cid), COORDS), -1, np.int64)
            for r, keys in enumerate(g.column("posted").to_pylist()):
                posted[r, : len(keys)] = keys
            rows = np.flatnonzero(block == i)
            cols = rows if i == j else np.flatnonzero(block == j)
            for r in rows:
                c = cols[(label[cols] != label[r]) & (cid[cols] > cid[r] if i == j else True)]
                c = c[100 * np.minimum(n[c], n[r]) >= percent * np.maximum(n[c], n[r])]
                c = c[(sig[c, :FIRST] == sig[r, :FIRST]).sum(axis=1) >= first]
                c = c[(sig[c] == sig[r]).sum(axis=1) >= fine]
                common = (posted[c][:, :, None] == posted[r][None, None, :]) & (posted[c] >= 0)[:, :, None]
                c = c[np.where(common.any(axis=2), posted[c], 1 << 62).min(axis=1) == key]  # a pair's other lists skip it
                if len(c):
                    out.append((np.minimum(cid[c], cid[r]), np.maximum(cid[c], cid[r])))
            if sum(len(x[0]) for x in out) > 50_000:
                yield _pairs(out)
                out = []
        if out:
            yield _pairs(out)

    return between


def _pairs(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    both = np.unique(np.stack([np.concatenate(x) for x in zip(*out, strict=True)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, rid_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, and rid and label.

    The match thresholds follow percent; it must be high enough that a pair at it has a match to ask for. rid tells rows with one id apart; rid_col gives it, a
    unique long, if there is one. label is the component's class, null for empty sets.
    """
    matches, _, _ = thresholds(percent)
    if matches < 1:
        raise ValueError(f"{COORDS} coordinates cannot find pairs at {percent} %")
    rid = F.col(rid_col) if rid_col else F.monotonically_increasing_id()
    base = docs.select(rid.alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = kept_table(base.mapInArrow(_sets, _SETS), "sets")
    held = sets.where("n > 0")
    classes = kept_table(held.groupBy("digest", "n").agg(F.min("rid").alias("cid"), F.min("doc_id").alias("least_id")), "classes")
    chosen = held.join(classes.select(F.col("cid").alias("rid")), "rid", "left_semi").select(F.col("rid").alias("cid"), "n", "coords")

    posted = chosen.select("cid", "n", F.explode("coords").alias("key"))
    often = kept_table(posted.groupBy("key").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "often")
    own = Window.partitionBy("cid")
    shared = posted.join(often, "key").withColumn("m", F.count(F.lit(1)).over(own)).where(F.col("m") >= matches)
    nth = F.row_number().over(own.orderBy("often", "key"))  # among shared values; those held once come before
    lists = kept_table(shared.withColumn("nth", nth).where(F.col("nth") + COORDS - F.col("m") <= COORDS - matches + 1).select("key", "cid", "n"), "lists")

    least = kept_table(lists.groupBy("key").agg(F.min(F.struct("cid", "n")).alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1"), "least")
    near = (F.least("n", "least.n") * 100 >= percent * F.greatest("n", "least.n")) & (F.col("cid") != F.col("least.cid"))
    star = lists.join(least, "key").where(near).select(F.col("least.cid").alias("a"), F.col("cid").alias("b")).distinct()
    at = held.select(F.col("rid"), "coords")
    star = star.join(at.withColumnsRenamed({"rid": "a", "coords": "ca"}), "a").join(at.withColumnsRenamed({"rid": "b", "coords": "cb"}), "b")
    agree = F.size(F.array_intersect("ca", "cb"))  # a coordinate's place is part of its value
    star = kept_table(star.where(agree >= matches).select("a", "b"), "star")
    texts = held.select(F.col("rid").alias("cid"), "z")
    labels = components(_confirmed(star, texts, percent))

    marked = lists.join(least.where("size > 1").select("key"), "key", "left_semi").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    marked = kept_table(marked.withColumn("label", F.coalesce("label", "cid")), "marked")
    split = marked.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi")
    split = kept_table(split.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("g")), "split")
    open_ = marked.join(split, "key")
    fine = texts.join(open_.select("cid").distinct(), "cid", "left_semi").mapInArrow(_fine, "cid long, sig binary")
    fine = kept_table(fine.join(lists.groupBy("cid").agg(F.collect_list("key").alias("posted")), "cid"), "fine")
    block = F.pmod(F.xxhash64("cid"), F.col("g")).cast("int")
    blocks = open_.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    blocks = blocks.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).join(fine, "cid")
    dealt = blocks.select("key", "i", "j", "cid", "n", "label", "block", "sig", "posted").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    between = kept_table(dealt.mapInArrow(_between(percent), "a long, b long").distinct(), "between")
    labels = relabelled(labels, _confirmed(between, texts, percent))

    of_class = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least_id = of_class.groupBy("label").agg(F.min("least_id").alias("component_id"))
    final = kept_table(of_class.join(least_id, "label").select("digest", "n", "component_id", "label"), "final")
    forget(classes, often, lists, least, star, marked, split, fine, between)
    held_out = sets.where("n > 0").select("rid", "doc_id", "n", "digest").join(final, ["digest", "n"])
    result = held_out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "rid", "label").unionByName(
        sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "rid", F.lit(None).cast("long").alias("label"))
    )
    return result.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "rid", "label")
