"""Suffix-array dedup: a depth-limited radix sort of all suffixes through `depth` bytes.

Suffixes are put in order only through the threshold, by digits from the most significant on, and a suffix that is
alone in its group leaves after that pass; groups equal through the last digit are exactly the repeated windows.

*First digit.* The 32 bytes at the window's minimiser (the place in the window whose 32 bytes hash lowest) and nothing
else of it. Neighbouring windows share their minimiser, so all suffixes from one minimiser travel as one row: about one row
per 80 bytes of text.
*Second digit.* The stretch that these windows cover together. Rows equal in it have all their windows repeated, so copies
and interior parts of shared passages end here. They are counted with partial sums; the counts go back to the rows by sort-merge joins
that are written at once, so a digit that very many rows share is split over tasks by the adaptive skew join.
*Last digits.* What is left are edges of repeats. There the place of the minimiser and the 200 bytes of each window are
sorted within its group. Groups of more than `PART` rows are dealt out over parts; windows alone in their part meet one of
each that another part holds, dealt by the window, so no group must fit in one task.

Digits after the first are compared by two independent 64-bit fingerprints together with those of the digits before, so of
10**15 rows two unlike ones are taken for alike with a probability under 10**-8.

Defined results: matches don't cross documents; a null text is empty; texts shorter than the depth lose nothing; very long
texts are read in segments of SEGMENT windows that overlap by a window, with the same result; repeated rows count as two places, so both lose what they
share; rows with one id or none are places of their own; ties don't occur, as all places of a repeated string go; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import encoded, forget, kept_table, mix, parts_of, sliced
from ravelin.llm.rolling import gram_hashes, sliding_least, span_hashes
from ravelin.llm.runs import runs
from ravelin.llm.spans import REMOVED, merged, text_hash, without_spans

DEPTH, GRAM = 200, 32
PART = 400
#: Windows handled at once within a very long text.
SEGMENT = 1 << 20

_DOC = ["doc_id", "thash"]


def anchors(data: bytes, depth: int = DEPTH) -> tuple[np.ndarray, ...]:
    """For every run of windows with one minimiser: its place, the first and the last window, digit one, and both halves of digit two."""
    whole, out = np.frombuffer(data, np.uint8), []
    for a in range(0, len(whole) - depth + 1, SEGMENT):
        b = whole[a : a + SEGMENT + depth - 1]
        g = gram_hashes(b, GRAM)
        place = (g >> np.uint64(32) << np.uint64(32)) | np.arange(len(g), dtype=np.uint64)
        at = (sliding_least(place, depth - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], len(at)] - 1
        p = at[first]
        two, three = (mix(h + (p - first).astype(np.uint64)).view(np.int64) for h in span_hashes(b, first, last + depth))
        out.append((p + a, first + a, last + a, g[p].view(np.int64), two, three))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(6))


def _rows(b: pa.RecordBatch) -> tuple[list, list[bytes]]:
    data = encoded(b.column("text"))
    return b.column("doc_id").to_pylist(), data


def _anchors(depth: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            ids, data = _rows(b)
            for at in range(0, len(data), 250):
                found = [anchors(x, depth) for x in data[at : at + 250]]
                n = [len(f[0]) for f in found]
                p, first, last, one, two, three = (np.concatenate(x) for x in zip(*found, strict=True))
                doc = pa.array(ids[at : at + 250], pa.int64()).take(pa.array(np.repeat(np.arange(len(n)), n)))
                th = np.repeat(np.array([text_hash(x) for x in data[at : at + 250]], np.int64), n)
                pack = (p << 16) | ((p - first) << 8) | (last - first)
                yield pa.RecordBatch.from_arrays([doc, pa.array(th), pa.array(one), pa.array(two), pa.array(three), pa.array(pack)], ["doc_id", "thash", "one", "two", "three", "pack"])

    return scan


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3)
    for b in sliced(batches):
        data = encoded(b.column("text"))
        th, z = [text_hash(x) for x in data], [squeeze.compress(x) for x in data]
        more = [n for n in b.schema.names if n not in ("doc_id", "text")]
        cols = [b.column("doc_id"), pa.array(th, pa.int64()), pa.array(z, pa.binary()), *(b.column(n) for n in more)]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "thash", "z", *more])


def _edges(depth: int):
    """The bytes of edge rows, from their documents."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor()
        names = ["one", "part", "hot", "times", "doc_id", "thash", "first", "place", "bytes"]
        kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for b in sliced(batches):
            out: list[list] = [[] for _ in names]
            for doc, th, z, rows in zip(*(b.column(x).to_pylist() for x in ("doc_id", "thash", "z", "edges")), strict=True):
                data = expand.decompress(z)
                for r in rows:
                    p, lo, n = r["pack"] >> 16, r["pack"] >> 8 & 255, r["pack"] & 255
                    first = p - lo
                    for x, v in zip(out, (r["one"], r["part"], r["hot"], r["times"], doc, th, first, lo, data[first : first + n + depth]), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    return cut


def _window_keys(t: pa.Table, depth: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """For all windows of edge rows: the row, which window of it, and the key by digits one to last, in two halves."""
    rows = t.column("bytes").to_pylist()
    size = np.array([len(x) for x in rows])
    base = np.r_[0, np.cumsum(size)[:-1]]
    n = size - depth + 1
    row = np.repeat(np.arange(len(rows)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = base[row] + nth
    both = span_hashes(np.frombuffer(b"".join(rows), np.uint8), start, start + depth)
    place = (t.column("place").to_numpy()[row] - nth).astype(np.uint64)
    group = mix(t.column("one").to_numpy().view(np.uint64)[row] + place * np.uint64(0xD6E8FEB86659FD93))
    return row, nth, (mix(both[0] + group), mix(both[1] + group))


def _sorted(key: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal pairs side by side, and where each run of equal pairs begins."""
    order = np.argsort(key, kind="stable")
    k, o = key[order], other[order]
    same = k[1:] == k[:-1]
    if (same & (o[1:] != o[:-1])).any():
        order = np.lexsort((other, key))
        k, o = key[order], other[order]
        same = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    return order, np.flatnonzero(np.r_[True, ~same])


_MOST = 232  # windows of a row, at most, in whole bytes


def _bits(row: np.ndarray, nth: np.ndarray, flags: np.ndarray, wanted: np.ndarray) -> pa.Array:
    """A bit per window for each wanted row, null for others."""
    m = np.zeros((len(wanted), _MOST), bool)
    m[row, nth] = flags
    packed = np.packbits(m, axis=1)
    return pa.array([packed[i].tobytes() if w else None for i, w in enumerate(wanted)], pa.binary())


def _flags(column: pa.ChunkedArray, row: np.ndarray, nth: np.ndarray) -> np.ndarray:
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, _MOST // 8)
    return np.unpackbits(packed, axis=1)[row, nth].astype(bool)


def _compare(depth: int):
    """Rows with the first and last of their windows that are repeated in their part (-1: none).

    Rows of groups in several parts also tell which windows are alone in their part (open), and for which they are the
    first of several (lead).
    """

    def flush(t: pa.Table) -> pa.RecordBatch:
        row, nth, key = _window_keys(t, depth)
        times, part = t.column("times").to_numpy()[row], t.column("part").to_numpy().astype(np.uint64)[row]
        order, edge = _sorted(*(mix(k + mix(part)) for k in key))
        total = np.add.reduceat(times[order], edge)
        good = np.zeros(len(order), bool)
        good[order] = np.repeat(total > 1, np.diff(np.r_[edge, len(order)]))
        lead = np.zeros(len(order), bool)
        lead[order[edge]] = total > 1
        hot = t.column("hot").to_numpy(zero_copy_only=False)
        lo, hi = np.full(len(t), 1 << 30), np.full(len(t), -1)
        np.minimum.at(lo, row[good], nth[good])
        np.maximum.at(hi, row[good], nth[good])
        t = t.append_column("lo", pa.array(np.where(hi < 0, -1, lo), pa.int32())).append_column("hi", pa.array(hi, pa.int32()))
        t = t.append_column("open", _bits(row, nth, ~good, hot)).append_column("lead", _bits(row, nth, lead, hot))
        return t.combine_chunks().to_batches()[0]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for b in batches:  # sorted by (one, part); a group may span batches
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            kept = pa.concat_tables([kept, t]) if kept is not None else t
            one, part = kept.column("one").to_numpy(), kept.column("part").to_numpy()
            ends = np.flatnonzero((one[1:] != one[:-1]) | (part[1:] != part[:-1]))
            if len(ends) and len(kept) >= 4000:
                yield flush(kept.slice(0, ends[-1] + 1))
                kept = kept.slice(ends[-1] + 1)
        if kept is not None:
            yield flush(kept)

    return compare


_OPEN = np.dtype([("key", "<u8"), ("other", "<u8"), ("doc", "<i8"), ("null", "?"), ("thash", "<i8"), ("start", "<i8"), ("times", "<i4")])


def _open(depth: int, shares: int):
    """Windows that a part can't decide, and one of each that it has twice, as blocks of records dealt by key."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            row, nth, key = _window_keys(t, depth)
            lead = _flags(t.column("lead"), row, nth)
            out = np.flatnonzero(_flags(t.column("open"), row, nth) | lead)
            x = np.zeros(len(out), _OPEN)
            row = row[out]
            doc = t.column("doc_id").combine_chunks()
            x["key"], x["other"] = key[0][out], key[1][out]
            x["doc"], x["null"] = doc.fill_null(0).to_numpy()[row], doc.is_null().to_numpy(zero_copy_only=False)[row]
            x["thash"], x["start"], x["times"] = t.column("thash").to_numpy()[row], t.column("first").to_numpy()[row] + nth[out], np.where(lead[out], 2, t.column("times").to_numpy()[row])
            share = ((x["key"] >> np.uint64(32)) % np.uint64(shares)).astype(np.int64)
            order = np.argsort(share, kind="stable")
            which, at = np.unique(share[order], return_index=True)
            parts = np.split(x[order], at[1:]) if len(which) else []
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["share", "block"])

    return blocks


def _late(depth: int):
    """Spans of windows that occur again in another part."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, g in runs(batches, ["share"]):
            x = np.concatenate([np.frombuffer(v, _OPEN) for v in g.column("block").to_pylist()])
            order, edge = _sorted(x["key"], x["other"])
            x = x[order]
            again = np.repeat(np.add.reduceat(x["times"], edge) > 1, np.diff(np.r_[edge, len(x)]))
            x = np.sort(x[again], order=["doc", "null", "thash", "start"])
            if len(x):
                new = np.r_[True, (x["doc"][1:] != x["doc"][:-1]) | (x["null"][1:] != x["null"][:-1]) | (x["thash"][1:] != x["thash"][:-1]) | (x["start"][1:] > x["start"][:-1] + 1)]
                a = np.flatnonzero(new)
                z = np.r_[a[1:], len(x)] - 1
                doc = pa.array(x["doc"][a], mask=x["null"][a])
                yield pa.RecordBatch.from_arrays([doc, pa.array(x["thash"][a]), pa.array(x["start"][a]), pa.array(x["start"][z] + depth)], ["doc_id", "thash", "lo", "hi"])

    return find


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """(doc_id, thash, lo, hi): byte spans that windows of `depth` bytes with another place cover; spans may overlap.

    A row of docs is found by its id and text_hash(text).
    """
    if not GRAM <= depth <= GRAM + 224:
        raise ValueError(f"depth is {GRAM} to {GRAM + 224} bytes")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scan = base.mapInArrow(_anchors(depth), "doc_id long, thash long, one long, two long, three long, pack long")
    ends = [f(c).alias(f"{n}_{c}") for c in ("two", "three") for n, f in (("lo", F.min), ("hi", F.max))]
    ones = scan.groupBy("one").agg(F.count(F.lit(1)).alias("n"), *ends).where("n > 1")
    ones = kept_table(ones.select("one", F.expr("lo_two = hi_two AND lo_three = hi_three").alias("alike")), "ones")
    shared = kept_table(scan.join(ones.hint("merge"), "one"), "shared")  # what follows asks for no order, so skewed keys can be split
    forget(ones)
    place = F.shiftright("pack", 16)
    first = place - F.shiftright("pack", 8).bitwiseAND(255)
    whole = [first.alias("lo"), (first + F.col("pack").bitwiseAND(255) + depth).alias("hi")]

    mixed = shared.where("NOT alike")
    digits = ["one", "two", "three"]
    twos = kept_table(mixed.groupBy(*digits).agg(F.count(F.lit(1)).alias("times")), "twos")
    mixed = kept_table(mixed.join(twos.hint("merge"), digits), "mixed")
    forget(twos)
    alone = mixed.where("times = 1").select(*_DOC, "one", "pack", F.lit(1).alias("times"))
    many = mixed.where("times > 1").select(*_DOC, *digits, "pack")
    keep = many.groupBy(*digits).agg(F.min(F.struct(*_DOC, "pack")).alias("x")).select("x.*", "one").select(*_DOC, "one", "pack", F.lit(2).alias("times"))
    edges = alone.unionByName(keep)
    sizes = kept_table(edges.groupBy("one").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")), "sizes")
    parts = kept_table(edges.join(sizes.hint("merge"), "one"), "parts")
    forget(sizes)
    edges = parts.withColumn("part", F.pmod(F.xxhash64(*_DOC, "pack"), F.col("parts")).cast("int"))
    by_doc = edges.groupBy(*_DOC).agg(F.collect_list(F.struct("one", "part", (F.col("parts") > 1).alias("hot"), "times", "pack")).alias("edges"))
    texts = base.where(F.octet_length("text") >= depth).mapInArrow(_texts, "doc_id long, thash long, z binary")
    by_doc = kept_table(by_doc.withColumnsRenamed({"doc_id": "ed", "thash": "et"}), "edges")  # edges of repeated rows count as two already
    same = F.col("doc_id").eqNullSafe(F.col("ed")) & (F.col("thash") == F.col("et"))
    cut = texts.join(by_doc, same).select(*_DOC, "z", "edges").mapInArrow(
        _edges(depth), "one long, part int, hot boolean, times int, doc_id long, thash long, first long, place int, bytes binary"
    )
    dealt = cut.repartition("one", "part").sortWithinPartitions("one", "part")
    schema = "one long, part int, hot boolean, times int, doc_id long, thash long, first long, place int, bytes binary, lo int, hi int, open binary, lead binary"
    compared = kept_table(dealt.mapInArrow(_compare(depth), schema), "compared")
    hot = compared.where("hot")
    shares = max(parts_of(docs.sparkSession), hot.count() // 5000 + 1)
    blocks = hot.mapInArrow(_open(depth, shares), "share long, block binary").repartition(shares, "share").sortWithinPartitions("share")
    late = blocks.mapInArrow(_late(depth), "doc_id long, thash long, lo long, hi long")

    near = compared.where("hi >= 0").select(*_DOC, (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi") + depth).alias("hi"))
    return shared.where("alike").select(*_DOC, *whole).unionByName(many.select(*_DOC, *whole)).unionByName(near).unionByName(late)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    expand = zstandard.ZstdDecompressor()
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_bytes"]
    for b in sliced(batches):
        out = []
        for z, spans in zip(b.column("z").to_pylist(), b.column("spans").to_pylist(), strict=True):
            data = expand.decompress(z)
            runs = merged([(s["lo"], s["hi"]) for s in spans or ()])
            kept = without_spans(data, runs)
            out.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [x for s in runs for x in s], kept))
        cols = list(zip(*out, strict=True)) or [()] * 6
        more = [n for n in b.schema.names if n not in ("doc_id", "z", "spans")]
        own = [pa.array(x, k) for x, k in zip(cols, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *own, *(b.column(n) for n in more)], [*names, *more])


def remove_spans(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Per row of docs what is left without spans(doc_id, thash, lo, hi); spans come out as lo, hi, lo, hi, ...

    carry: also the other columns of docs, in the struct `row`.
    """
    row = F.struct(*(c for c in docs.columns if c != text_col)).alias("row")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([row] if carry else []))
    more = f", row {base.schema['row'].dataType.simpleString()}" if carry else ""
    texts = base.mapInArrow(_texts, f"doc_id long, thash long, z binary{more}")
    by_doc = spans.groupBy(*_DOC).agg(F.collect_set(F.struct("lo", "hi")).alias("spans")).withColumnsRenamed({"doc_id": "sd", "thash": "st"})
    by_doc = kept_table(by_doc, "spans")
    joined = texts.join(by_doc, F.col("doc_id").eqNullSafe(F.col("sd")) & (F.col("thash") == F.col("st")), "left").select("doc_id", "z", "spans", *(["row"] if carry else []))
    return joined.mapInArrow(_remove, REMOVED + more)


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans and kept_bytes, one row per input row."""
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col, depth=depth)
    return remove_spans(docs, spans, id_col=id_col, text_col=text_col)
