"""Token counts by offset-mapped attribution.

A document is encoded once, whole. The bytes of its ids give each token's character span, and an interval join with the
sections' spans attributes it. A token that crosses a boundary goes by the rule: to the section of its first character
(`start`), of its last (`end`), or to the one that holds most of its characters (`most`; ties to the earlier). A character
is the token's if any of its bytes is. Sections here are a text's lines, each with the line break that ends it.

Defined results: a null or empty text has one empty section; a very long text is encoded whole, with a row for each of its lines; repeated
rows are counted one by one; ties of `most` go to the earlier section; an empty table gives an empty result; other columns of the input
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import sliced
from ravelin.llm.tokens import byte_lengths, default_vocabulary, ids_of

RULES = ("start", "end", "most")


def token_spans(text: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of every token of a text."""
    ends = np.cumsum(byte_lengths(path)[ids_of(text, path)])
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    data = np.frombuffer(text.encode(), np.uint8)
    if len(data) == len(text):
        return starts, ends
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    return char[starts], char[ends - 1] + 1


def lines_of(text: str) -> np.ndarray:
    """Starts of lines; the next start ends a line."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts = np.r_[0, np.flatnonzero(code == 10) + 1]
    return starts[:-1] if len(starts) > 1 and starts[-1] == len(code) else starts


def attribute(first: np.ndarray, end: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of every token, and whether the token crosses a boundary. sections: sorted starts."""
    a = np.searchsorted(sections, first, "right") - 1
    z = np.searchsorted(sections, end - 1, "right") - 1
    if rule == "start":
        return a, a != z
    if rule == "end":
        return z, a != z
    best = a.copy()
    for i in np.flatnonzero(a != z):
        edges = np.r_[first[i], sections[max(a[i] + 1, 0) : z[i] + 1], end[i]]
        best[i] = a[i] + int(np.argmax(np.diff(edges)))
    return best, a != z


def _counts(path: str, rule: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            for text in b.column("text").to_pylist():
                text = text or ""
                first, end = token_spans(text, path)
                starts = lines_of(text)
                at, cross = attribute(first, end, starts, rule)
                ends = np.r_[starts[1:], len(text)]
                for x, v in zip(cols, (np.arange(len(starts)), starts, ends, np.bincount(at, minlength=len(starts)), np.bincount(at[cross], minlength=len(starts)), [len(first)]), strict=True):
                    x.append(np.asarray(v, np.int64))
            if cols[0]:
                n = [len(x) for x in cols[0]]
                pick = pa.array(np.repeat(np.arange(len(n)), n))
                doc = b.column("doc_id").take(pick)
                total = np.repeat(np.concatenate(cols[5]), n)
                yield pa.RecordBatch.from_arrays([doc, *(pa.array(np.concatenate(x)) for x in cols[:5]), pa.array(total)], ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing", "doc_tokens"])

    return count


def section_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, rule: str = "most") -> DataFrame:
    """doc_id, section, char_start, char_end, n_tokens, n_crossing (of these, tokens over a boundary), doc_tokens."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, section long, char_start long, char_end long, n_tokens long, n_crossing long, doc_tokens long"
    return base.mapInArrow(_counts(vocabulary or default_vocabulary(), rule), schema)
