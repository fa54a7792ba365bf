"""Substring dedup by content-defined chunking.

A gear rolling hash over the last 32 bytes decides where a chunk ends, so cuts follow the content: after an insertion they
are soon the same again. Chunks are told apart by a 128-bit digest. Of chunks with one digest the document with the
smallest id keeps its first; all others are repeats. Repeats are removed where neighbouring ones make up `least` bytes
or more, so short chunks that recur by chance stay.

Texts are read and hashed once. The scan deals documents into blocks of bounded size and numbers each block's distinct
digests. A digest travels once per block, however many documents hold it, meets those of the other blocks by its value, and
an answer goes back only to the blocks that hold a repeated one. There a block's answers lie in memory while its
documents stream by. A passage that many documents share is thus never gathered in one place.

Defined results: a null or empty text has no chunks and loses nothing; a very long text may make its block larger by its
own chunks; of ties in a document the first place is kept; rows with one id keep alike (what one keeps the other keeps),
so rows equal in id and text keep all that is theirs to keep; rows with a null id keep nothing that a row with an id
holds, and of those that differ in text the one whose text hashes lowest keeps; an empty table gives an empty result;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ravelin.llm.common import encoded, kept_table, parts_of, sliced
from ravelin.llm.runs import runs
from ravelin.llm.spans import REMOVED, merged, text_hash, without_spans

AVERAGE_BITS, SMALLEST, LARGEST = 5, 16, 512
#: Bytes that neighbouring repeats must make up.
LEAST = 64
#: Distinct chunks of a block, about.
HOLD = 1 << 17
#: Bytes of text whose digests meet in one share, which a worker holds at once: about a million digests.
SHARE_BYTES = 48 << 20

GEAR = np.random.default_rng(64).integers(0, 2**32, 256, dtype=np.uint32)


def gear(b: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i - 1] + GEAR[b[i]] modulo 2**32, by doubling the window."""
    h, size = GEAR[b], 1
    while size < 32 and size < len(h):
        grown = h.copy()
        grown[size:] += h[:-size] << np.uint32(size)
        h, size = grown, size * 2
    return h


def chunk_ends(data: bytes, bits: int = AVERAGE_BITS, smallest: int = SMALLEST, largest: int = LARGEST) -> list[int]:
    """Where chunks end: never within a character; the last is the text's end."""
    if not data:
        return []
    b = np.frombuffer(data, np.uint8)
    whole = np.r_[(b[1:] & 0xC0) != 0x80, True]
    cuts = (np.flatnonzero((gear(b) >> np.uint32(32 - bits) == 0) & whole) + 1).tolist()
    ends, at = [], 0
    for c in [*cuts, len(data)]:
        while c - at > largest:
            at += largest
            while at < c and data[at] & 0xC0 == 0x80:
                at += 1
            ends.append(at)
        if c - at >= smallest:
            ends.append(c)
            at = c
    if at < len(data):
        ends.append(len(data))
    return ends


_NONE = np.iinfo(np.int64).max


def _squeezed(x: np.ndarray, kind: str) -> bytes:
    import zstandard

    return zstandard.compress(x.astype(kind).tobytes(), 1)


def _expanded(z: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(z), kind)


#: What a digest brings to its meeting: a block's number for it, its two halves, the smallest id in the block (null: the
#: largest long), the smallest hash of a text without an id (likewise), and whether the block holds it more than once.
_MEETS = (("i", "<u4"), ("d1", "<i8"), ("d2", "<i8"), ("doc", "<i8"), ("nameless", "<i8"), ("twice", "u1"))
_ANSWERS = (("i", "<u4"), ("doc", "<i8"), ("nameless", "<i8"))


def _packed(parts: dict[str, np.ndarray], fields: tuple) -> bytes:
    """Columns one after another, each compressed: ids that rise and flags that are alike take little room."""
    cols = [_squeezed(parts[n], k) for n, k in fields]
    return np.array([len(parts[fields[0][0]]), *map(len, cols)], "<i8").tobytes() + b"".join(cols)


def _unpacked(blobs: list[bytes], fields: tuple) -> dict[str, np.ndarray]:
    out: dict[str, list[np.ndarray]] = {n: [] for n, _ in fields}
    for b in blobs:
        size = np.frombuffer(b, "<i8", len(fields) + 1)[1:]
        at = 8 * (len(fields) + 1)
        for (n, k), z in zip(fields, size.tolist(), strict=True):
            out[n].append(_expanded(b[at : at + z], k))
            at += z
    return {n: np.concatenate(x) if x else np.zeros(0, k) for (n, x), (_, k) in zip(out.items(), fields, strict=True)}


class _Block:
    """The distinct digests of a block, numbered in order of appearance."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, digests: list[bytes], doc: np.ndarray, nameless: np.ndarray) -> np.ndarray:
        number = self.number
        i = np.fromiter((number.setdefault(d, len(number)) for d in digests), np.int64, len(digests))
        self.seen.append((i, doc, nameless))
        return i

    def shares(self, n: int) -> Iterator[tuple[int, bytes]]:
        """Digests dealt by their value."""
        i, doc, nameless = (np.concatenate(x) for x in zip(*self.seen, strict=True))
        d = np.frombuffer(b"".join(self.number), "<i8").reshape(-1, 2)
        least = [np.full(len(d), _NONE) for _ in range(2)]
        np.minimum.at(least[0], i, doc)
        np.minimum.at(least[1], i, nameless)
        twice = np.bincount(i, minlength=len(d)) > 1
        share = (d[:, 0].astype(np.uint64) >> np.uint64(20)) % np.uint64(n)
        order = np.argsort(share, kind="stable")
        which, at = np.unique(share[order], return_index=True)
        for s, own in zip(which.tolist(), np.split(order, at[1:]), strict=True):
            yield s, _packed({"i": own, "d1": d[own, 0], "d2": d[own, 1], "doc": least[0][own], "nameless": least[1][own], "twice": twice[own]}, _MEETS)


def _chunks(bits: int, smallest: int, largest: int, shares: int, more: list[pa.Field]):
    """Documents with the sizes and numbers of their chunks, and after those of a block its digests by share."""
    names = ["block", "doc_id", "z", "sizes", "numbers", *(f.name for f in more), "share", "digests"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), *(f.type for f in more), pa.int32(), pa.binary()]

    def batch(n: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given[x] if isinstance(given.get(x), (pa.Array, pa.ChunkedArray)) else pa.array(given[x], k) if x in given else pa.nulls(n, k) for x, k in zip(names, kinds, strict=True)], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        digest, squeeze = xxhash.xxh3_128_digest, zstandard.ZstdCompressor(level=3)
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for b in sliced(batches):
            data = encoded(b.column("text"))
            for at in range(0, len(data), 250):
                part, rows = data[at : at + 250], b.slice(at, 250)
                ends = [chunk_ends(x, bits, smallest, largest) for x in part]
                n = np.array([len(e) for e in ends])
                null = rows.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                doc = np.where(null, _NONE, rows.column("doc_id").fill_null(0).to_numpy())
                nameless = np.where(null, np.array([text_hash(x) for x in part], np.int64), _NONE)
                i = block.add([digest(x[s:e]) for x, own in zip(part, ends, strict=True) for s, e in zip([0, *own], own, strict=False)], np.repeat(doc, n), np.repeat(nameless, n))
                yield batch(
                    len(part), block=[number] * len(part), doc_id=rows.column("doc_id"), z=[squeeze.compress(x) for x in part],
                    sizes=[np.diff(e, prepend=0).astype("<u4").tobytes() for e in ends],
                    numbers=[x.astype("<u4").tobytes() for x in np.split(i, np.cumsum(n)[:-1])], **{f.name: rows.column(f.name) for f in more},
                )
                if len(block.number) >= HOLD:
                    yield from (batch(1, block=[number], share=[s], digests=[x]) for s, x in block.shares(shares))
                    number, block = number + 1, _Block()
        if block.number:
            yield from (batch(1, block=[number], share=[s], digests=[x]) for s, x in block.shares(shares))

    return scan


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every block, who keeps those of its digests that occur more than once. Rows are sorted by share."""
    for _, g in runs(batches, ["share"]):
        blobs, of = g.column("digests").to_pylist(), g.column("block").to_numpy()
        x = _unpacked(blobs, _MEETS)
        block = np.repeat(of, [int(np.frombuffer(b, "<i8", 1)[0]) for b in blobs])
        order = np.lexsort((x["d2"], x["d1"]))
        d1, d2 = x["d1"][order], x["d2"][order]
        head = np.flatnonzero(np.r_[True, (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])])
        size = np.diff(np.r_[head, len(d1)])
        again = np.repeat((size > 1) | np.maximum.reduceat(x["twice"][order], head).astype(bool), size)
        least = {n: np.repeat(np.minimum.reduceat(x[n][order], head), size)[again] for n in ("doc", "nameless")}
        block, i = block[order][again], x["i"][order][again]
        by = np.lexsort((i, block))
        which, at = np.unique(block[by], return_index=True)
        answers = [_packed({"i": i[own], **{n: v[own] for n, v in least.items()}}, _ANSWERS) for own in (np.split(by, at[1:]) if len(which) else [])]
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(answers, pa.binary())], ["block", "answer"])


def _settle(least: int, more: list[str]):
    """What is left of documents. Rows are sorted by block, with a block's answers first."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand, now, blobs, known = zstandard.ZstdDecompressor(), None, [], {}
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_bytes"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary()]
        for b in batches:
            blocks, answers = b.column("block").to_numpy(), b.column("answer").to_pylist()
            ids, zs, sizes, numbers = (b.column(c).to_pylist() for c in ("doc_id", "z", "sizes", "numbers"))
            here, out = [], []
            for r, answer in enumerate(answers):
                if blocks[r] != now:
                    now, blobs, known = blocks[r], [], {}
                if answer is not None:
                    blobs.append(answer)
                    continue
                if not known:
                    x = _unpacked(blobs, _ANSWERS)
                    known = {n: np.full(int(x["i"].max(initial=0)) + 2, -1 if n == "doc" else _NONE) for n in ("doc", "nameless")}
                    known["again"] = np.zeros(len(known["doc"]), bool)
                    for n in ("doc", "nameless"):
                        known[n][x["i"]] = x[n]
                    known["again"][x["i"]] = True
                data = expand.decompress(zs[r])
                i = np.minimum(np.frombuffer(numbers[r], "<u4").astype(np.int64), len(known["again"]) - 1)
                spans = []
                if (again := known["again"][i]).any():
                    ends = np.cumsum(np.frombuffer(sizes[r], "<u4").astype(np.int64))
                    own = known["doc"][i] == ids[r] if ids[r] is not None else (known["doc"][i] == _NONE) & (known["nameless"][i] == text_hash(data))
                    first = np.zeros(len(i), bool)
                    first[np.unique(i, return_index=True)[1]] = True
                    gone = np.flatnonzero(again & ~(own & first))
                    spans = [s for s in merged(list(zip(np.r_[0, ends[:-1]][gone].tolist(), ends[gone].tolist(), strict=True))) if s[1] - s[0] >= least]
                kept = without_spans(data, spans)
                here.append(r)
                out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [x for s in spans for x in s], kept))
            if here:
                rows = b.take(pa.array(here))
                own = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *own, *(rows.column(n) for n in more)], ["doc_id", *names, *more])

    return settle


def chunk_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits: int = AVERAGE_BITS, smallest: int = SMALLEST,
    largest: int = LARGEST, least: int = LEAST, carry: bool = False,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans and kept_bytes, one row per input row.

    carry: also the other columns of docs, in the struct `row`.
    """
    whole = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = parts_of(docs.sparkSession)
    shares = max(parts, int(whole // SHARE_BYTES) + 1)
    row = [F.struct(*(c for c in docs.columns if c != text_col)).alias("row")] if carry else []
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *row)
    kind = f", row {base.schema['row'].dataType.simpleString()}" if carry else ""
    more = [pa.field("row", to_arrow_type(base.schema["row"].dataType))] if carry else []
    schema = f"block long, doc_id long, z binary, sizes binary, numbers binary{kind}, share int, digests binary"
    coded = kept_table(base.mapInArrow(_chunks(bits, smallest, largest, shares, more), schema), "chunks")
    dealt = coded.where("share IS NOT NULL").select("share", "block", "digests").repartition(shares, "share").sortWithinPartitions("share")
    answers = dealt.mapInArrow(_meet, "block long, answer binary")
    both = answers.unionByName(coded.where("share IS NULL").drop("share", "digests"), allowMissingColumns=True)
    by_block = both.repartition(parts, "block").sortWithinPartitions("block", F.col("answer").isNull())
    return by_block.mapInArrow(_settle(least, ["row"] if carry else []), REMOVED + kind)
