"""Quality rules: cross-document line frequency.

Lines are normalised (A-Z lower-cased, white space made single) and hashed. For every host the number of distinct
documents that hold a line is counted; documents of one host with the same text are one document, so copies alone
never make a line frequent. A line is removed where its count exceeds both `min_docs` and `share` of the host's
distinct documents, or where more than `most` documents of the host hold it, however large the host. A document is rejected if it fails a base rule, or if the removed lines leave less than
`least_left` of its words.

Defined results: a null text is an empty one, and an empty one fails the base rules; very long texts are measured whole; a line at a
limit is not over it (so ties stay); rows with the same id are judged one by one, rows equal in all columns alike; a null host is a host of its
own; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import encoded, kept_table, row_key, sliced, SPACES

SYMBOLS = b"#*$%&|<>"  # fixed values of the base measure

MIN_DOCS, SHARE, MOST, LEAST_LEFT = 30, 0.1, 10_000, 0.3

_SCHEMA = (
    "rid long, doc_id long, host string, digest long, n_words long, word_chars long, n_symbols long, "
    "n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"
)


def without(data: bytes, drop: bytes) -> int:
    return len(data) - len(data.translate(None, drop))


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, total, free = Counter(windows), 0, 0  # free: the first word not yet counted
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(i, free)
            free = i + 3
    return total


def line_key(line: bytes) -> int:
    """Signed 64-bit hash of a normalised line."""
    import xxhash

    h = xxhash.xxh3_64_intdigest(b" ".join(line.lower().split()))
    return h - (1 << 64) if h >> 63 else h


def measured(data: bytes) -> tuple:
    """The base measures of a text, and its distinct normalised lines with the words each takes."""
    import xxhash

    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    chars = len(data.decode("utf-8", "replace")) - without(data, SPACES)
    held: dict[int, int] = {}
    for x in lines:
        k = line_key(x)
        held[k] = held.get(k, 0) + len(x.split())
    digest = xxhash.xxh3_64_intdigest(data)
    return (
        digest - (1 << 64) if digest >> 63 else digest, len(words), chars, without(data, SYMBOLS),
        len(lines) - len(set(lines)), repeat_words(words), list(held), list(held.values()),
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 6 + [pa.list_(pa.int64()), pa.list_(pa.int32())]
    for b in sliced(batches):
        rows = list(zip(*map(measured, encoded(b.column("text"))), strict=True)) or [()] * 8
        digest, *rest = [pa.array(x, k) for x, k in zip(rows, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column("rid"), b.column("doc_id"), b.column("host"), digest, *rest],
            ["rid", "doc_id", "host", "digest", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"],
        )


def frequent_lines(measures: DataFrame, min_docs: int, share: float, most: int) -> DataFrame:
    """(host, line, docs): lines in more distinct documents of their host than min_docs and than the share of it, or `most`."""
    texts = measures.select("host", "digest", "lines").groupBy("host", "digest").agg(F.first("lines").alias("lines"))
    hosts = texts.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    lines = texts.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs"))
    over = lines.where(F.col("docs") > min_docs).join(hosts.where(F.col("host_docs") > min_docs), "host")
    return over.where(F.col("docs") > F.least(share * F.col("host_docs"), F.lit(float(most)))).select("host", "line", "docs")


def line_rules(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    min_docs: int = MIN_DOCS, share: float = SHARE, most: int = MOST, least_left: float = LEAST_LEFT, carry: bool = False,
) -> DataFrame:
    """One row per input row: the base measures, words removed as frequent lines, base_failed and kept.

    carry: only kept rows, with the input's other columns in a struct `row` and the text without its frequent lines in `clean_text`.
    """
    rid, kind = (row_key(F.col(id_col), F.col(text_col)), "struct<a:long,b:long>") if carry else (F.monotonically_increasing_id(), "long")
    base = docs.select(
        rid.alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
        F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("")).alias("host"),
        *([F.struct(*[c for c in docs.columns if c != text_col]).alias("row")] if carry else []),
    )
    measures = base.select("rid", "doc_id", "host", "text").mapInArrow(_measure, _SCHEMA.replace("rid long", f"rid {kind}"))
    measures = kept_table(measures.dropDuplicates(["rid", "host"]) if carry else measures, "lines")
    often = kept_table(frequent_lines(measures, min_docs, share, most), "often")
    own = ["rid", "host"] if carry else ["rid"]  # equal rows of one host share a verdict
    posted = measures.select("rid", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x"))
    hit = posted.select("rid", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("w")).join(often.select("host", "line"), ["host", "line"])
    removed = hit.groupBy(*own).agg(F.sum("w").alias("n_removed_words"), F.collect_list("line").alias("frequent"))
    out = measures.drop("lines", "line_words", "digest").join(removed, own, "left")
    out = out.withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long")).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed_words") >= least_left * F.col("n_words")))
    result = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words"]
    if not carry:
        return out.select(*result)
    kept = base.select(*own, "row", "text").join(out.where("kept").select(*own, *result, "frequent"), own)
    plain = kept.where("frequent IS NULL").select(*result, "row", F.col("text").alias("clean_text"))
    cut = kept.where("frequent IS NOT NULL").select(*result, "row", "text", "frequent")
    fields = plain.schema
    return plain.unionByName(cut.mapInArrow(_cut(fields.names), fields))


def _cut(names: list[str]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            clean = [strip_lines(t, set(f)) for t, f in zip(encoded(b.column("text")), b.column("frequent").to_pylist(), strict=True)]
            given = {"clean_text": pa.array([x.decode("utf-8", "replace") for x in clean], pa.string())}
            yield pa.RecordBatch.from_arrays([given[n] if n in given else b.column(n) for n in names], names)

    return cut


def strip_lines(data: bytes, frequent: set[int]) -> bytes:
    """The text without the lines whose keys are given."""
    return b"\n".join(x for x in data.split(b"\n") if not (x.strip() and line_key(x) in frequent))
