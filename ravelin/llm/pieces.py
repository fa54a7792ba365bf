"""SentencePiece encoding and decoding by suffix-array matching.

A model file's pieces (BPE with byte fallback, identity normalisation) are matched against a whole batch at once. A batch's
texts are cut where no piece can cross: before a space that follows something else, and around characters that no longer
piece holds. The distinct units of the batch are concatenated, and a suffix array of that text, ordered through eight bytes,
is built; longer pieces are compared on. Every piece is found by binary search: its occurrences are one range of the array. The resulting
edges (position, length, piece) are sorted by position and relaxed: in each unit the best edge that joins two
neighbouring symbols is applied until none is left. What no piece covers falls back to bytes. Ids are those of the
sentencepiece library.

Decoding joins pieces and bytes. It gives the text back, but that U+2581 in a text comes back as a space.

Defined results: a null or empty text has no ids and decodes to an empty text; a very long text is cut into units like any other; of
edges that tie the leftmost is applied first; repeated rows are encoded one by one; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import sliced

SPACE = "▁"
#: Units of more characters are relaxed with a heap, one by one.
LONG = 200
#: Units remembered by a worker; what is remembered never changes a result.
REMEMBERED = 600_000
_NONE = np.iinfo(np.int32).max
_WIDE = 8  # bytes of a suffix that are sorted; longer pieces are compared further on


class Vocabulary:
    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        text = {i: model.id_to_piece(i) for i in range(n)}
        self.ids = np.array(normal, np.int32)
        self.bytes = [text[i].encode() for i in normal]
        self.order = np.zeros(n, np.int32)  # rank by score, best first
        self.order[normal] = np.argsort(np.argsort([-model.get_score(i) for i in normal], kind="stable"), kind="stable")
        self.rank, self.length = self.order[normal].astype(np.int64), np.array([len(p) for p in self.bytes])
        self.low, self.high = (np.array([_number(p, f) for p in self.bytes], np.uint64) for f in (b"\0", b"\xff"))
        self.low2, self.high2 = (np.array([_number(p[_WIDE:], f) for p in self.bytes], np.uint64) for f in (b"\0", b"\xff"))
        self.by_order = np.zeros(len(normal), np.int32)
        self.by_order[self.order[normal]] = normal
        self.of_byte = np.zeros(256, np.int32)
        self.surface = [b""] * n
        for i in normal:
            self.surface[i] = text[i].encode().replace(SPACE.encode(), b" ")
        for i in range(n):
            if model.is_byte(i):
                b = int(text[i][3:5], 16)
                self.of_byte[b], self.surface[i] = i, bytes([b])
        joined = {c for i in normal if len(text[i]) > 1 for c in text[i]} - {SPACE}
        inside = re.escape("".join(sorted(joined)))
        self.units = re.compile(f"{SPACE}*[{inside}]+|{SPACE}+|[^{inside}{SPACE}]", re.DOTALL)
        self.known: dict[str, int] = {}
        self.flat, self.first, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in order of their next eight bytes, these bytes in that order, and the eight bytes at every position."""
    rows = np.lib.stride_tricks.sliding_window_view(np.r_[data, np.zeros(_WIDE, np.uint8)], _WIDE)[: len(data)]
    digit = np.ascontiguousarray(rows).view(">u8").astype(np.uint64).ravel()
    order = np.argsort(digit)
    return order, digit[order], digit


def _number(piece: bytes, fill: bytes) -> int:
    return int.from_bytes(piece[:_WIDE].ljust(_WIDE, fill), "big")


def edges(data: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(position * 1024 + length, rank) of all occurrences of pieces, sorted by position."""
    order, keys, digit = suffix_array(data)
    lo, hi = np.searchsorted(keys, v.low), np.searchsorted(keys, v.high, "right")
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    at = order[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
    size = v.length[which]
    rest = np.flatnonzero(size > _WIDE)  # compared on
    if len(rest):
        good, raw = np.ones(len(which), bool), data.tobytes()
        after = np.r_[digit, np.zeros(_WIDE, np.uint64)][at[rest] + _WIDE]
        w = which[rest]
        good[rest] = (after >= v.low2[w]) & (after <= v.high2[w])
        for i in np.flatnonzero(good & (size > 2 * _WIDE)):
            good[i] = raw.startswith(v.bytes[which[i]], at[i])
        which, at, size = which[good], at[good], size[good]
    packed = np.sort((at * 1024 + size) << 24 | v.rank[which])
    return packed >> 24, packed & 0xFFFFFF


class Edges:
    def __init__(self, key: np.ndarray, rank: np.ndarray) -> None:
        self.key, self.rank = np.r_[key, np.iinfo(np.int64).max], np.r_[rank, _NONE]

    def __call__(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        want = at * 1024 + size
        i = np.searchsorted(self.key, want)
        return np.where((self.key[i] == want) & (size < 1024), self.rank[i], _NONE)


def _relax_long(start: list[int], end: list[int], find: Edges) -> tuple[list[int], list[int]]:
    n = len(start)
    right, left, alive = list(range(1, n)) + [-1], [-1, *range(n - 1)], [True] * n
    first = find(np.array(start[:-1]), np.array(end[1:]) - np.array(start[:-1]))
    heap = [(int(r), i, end[i + 1]) for i, r in enumerate(first) if r != _NONE]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        j = right[i] if alive[i] else -1
        if j < 0 or end[j] != to:
            continue
        end[i], alive[j], right[i] = end[j], False, right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b >= 0:
                r = int(find(np.array([start[a]]), np.array([end[b] - start[a]]))[0])
                if r != _NONE:
                    heapq.heappush(heap, (r, a, end[b]))
    return [s for s, ok in zip(start, alive, strict=True) if ok], [e for e, ok in zip(end, alive, strict=True) if ok]


def relax(start: np.ndarray, end: np.ndarray, unit: np.ndarray, find: Edges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after all joins: in each unit the best edge over two neighbours first, the leftmost of equal ones."""
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    sizes = np.bincount(unit)
    for u in np.flatnonzero(sizes > LONG):
        own = unit == u
        s, e = _relax_long(start[own].tolist(), end[own].tolist(), find)
        done.append((np.array(s), np.array(e), np.full(len(s), u)))
    keep = sizes[unit] <= LONG
    start, end, unit = start[keep], end[keep], unit[keep]
    rank = np.full(len(start), _NONE)
    pair = np.flatnonzero(unit[1:] == unit[:-1])
    rank[pair] = find(start[pair], end[pair + 1] - start[pair])
    while len(start):
        head = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        count = np.diff(np.r_[head, len(unit)])
        best = np.minimum.reduceat(rank.astype(np.int64) << 32 | np.arange(len(rank)), head)
        ready = (best >> 32) == _NONE
        if ready.any():
            out = np.repeat(ready, count)
            done.append((start[out], end[out], unit[out]))
            best = best[~ready]
        i = best & 0xFFFFFFFF
        if not len(i):
            break
        live = np.ones(len(start), bool)
        end[i] = end[i + 1]
        live[i + 1] = False
        touched = np.zeros(len(start), bool)
        touched[i] = True
        if ready.any():
            live &= ~out
        start, end, unit, rank, touched = start[live], end[live], unit[live], rank[live], touched[live]
        touched[:-1] |= touched[1:]
        again = np.flatnonzero(touched)
        follows = np.zeros(len(again), bool)
        inner = again < len(start) - 1
        follows[inner] = unit[again[inner]] == unit[again[inner] + 1]
        rank[again[~follows]] = _NONE
        a = again[follows]
        rank[a] = find(start[a], end[a + 1] - start[a])
    s, e, u = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (start, end, unit)
    by = np.lexsort((s, u))
    return s[by], e[by], u[by]


def encode_units(units: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units in a row, and how many each has; all are matched at once."""
    raw = [u.encode() for u in units]
    data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
    size = np.array([len(x) for x in raw])
    base = np.r_[0, np.cumsum(size + 1)[:-1]]
    inside = np.ones(len(data), bool)
    inside[base + size] = False
    start = np.flatnonzero(inside & ((data & 0xC0) != 0x80))
    unit = np.searchsorted(base, start, "right") - 1
    end = np.r_[start[1:], len(data)]
    end = np.minimum(end, (base + size)[unit])
    find = Edges(*edges(data, v))
    s, e, u = relax(start, end, unit, find)
    rank = find(s, e - s)
    n = np.where(rank == _NONE, e - s, 1)
    ids = np.zeros(n.sum(), np.int32)
    to = np.r_[0, np.cumsum(n)[:-1]]
    good = rank != _NONE
    ids[to[good]] = v.by_order[rank[good]]
    for i in np.flatnonzero(~good):
        ids[to[i] : to[i] + n[i]] = v.of_byte[data[s[i] : e[i]]]
    return ids, np.bincount(u, weights=n, minlength=len(units)).astype(np.int64)


def encode_batch(texts: list[str], v: Vocabulary) -> list[np.ndarray]:
    """Ids of whole texts."""
    cut = [v.units.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
    if len(v.known) > REMEMBERED or len(v.flat) > 20 * REMEMBERED:
        v.known.clear()
        v.flat, v.first, v.size = v.flat[:0], v.first[:0], v.size[:0]
    new = [u for u in dict.fromkeys(u for c in cut for u in c) if u not in v.known]
    if new:
        made, size = encode_units(new, v)
        v.known.update(zip(new, range(len(v.known), len(v.known) + len(new)), strict=True))
        v.first = np.r_[v.first, len(v.flat) + np.r_[0, np.cumsum(size)[:-1]]]
        v.flat, v.size = np.r_[v.flat, made], np.r_[v.size, size]
    out = []
    for c in cut:
        at = np.fromiter(map(v.known.__getitem__, c), np.int64, len(c))
        n = v.size[at]
        to = np.cumsum(n)
        out.append(v.flat[np.repeat(v.first[at] - np.r_[0, to[:-1]], n) + np.arange(to[-1])] if len(at) else np.zeros(0, np.int32))
    return out


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    surface = v.surface
    return b"".join([surface[i] for i in ids.tolist()])[1:].decode("utf-8", "replace")


def _encode(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in sliced(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids = encode_batch(texts, v)
            flat = np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)
            ends = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "text", "ids"])

    return encode


def _decode(path: str):
    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            text = [decode(np.array(x, np.int32), v) if x else "" for x in b.column("ids").to_pylist()]
            names = [*(n for n in b.schema.names if n != "decoded"), "decoded"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names[:-1]), pa.array(text, pa.string())], names)

    return back


def encode_pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, text, ids."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(_encode(model or default_model()), "doc_id long, text string, ids array<int>")


def decode_pieces(encoded: DataFrame, *, model: str | None = None) -> DataFrame:
    """The input (with a column ids), and the text in the column decoded."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name != "decoded")
    return encoded.mapInArrow(_decode(model or default_model()), f"{fields}, decoded string")


def _digest(path: str):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        plain = np.zeros(len(v.surface), bool)
        plain[v.of_byte] = True
        for b in sliced(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids = encode_batch(texts, v)
            cols = (
                [len(x) for x in ids], [int(plain[x].sum()) for x in ids], [zlib.crc32(x.astype("<u4").tobytes()) for x in ids],
                [decode(x, v) == t.replace(SPACE, " ") for x, t in zip(ids, texts, strict=True)],
            )
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, k) for x, k in zip(cols, kinds, strict=True))], ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"])

    return digest


def piece_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_crc32, and whether decoding gives the text back: encoding and decoding in one scan."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(_digest(model or default_model()), "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean")
