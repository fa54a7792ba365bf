"""Language ID: string-kernel classification.

The kernel is a blended spectrum over presence: texts are compared by which character n-grams (1 to 4, lower-cased) they
hold at all, k(x, y) = |both| / sqrt(|x| |y|). Nystroem landmarks give a finite feature map, in which kernel ridge
regression is solved once, one language against the rest. N-grams are hashed to BUCKETS places. As scores are linear in
the presence vector, landmarks and weights are folded into one matrix; texts are scored by batched products with it.

The classifier is fitted on at most `per_lang` labelled rows of each language, chosen by a hash of the id (the bound is a
parameter). It is applied to every whole text.

Defined results: `und` with score 0 if the text is null or has no letter, or if there is nothing to learn from; a row with
a null id is never learned from and not held out; very long texts are read whole, and a text's result depends on nothing else; of
languages that tie the first by name is told; repeated rows get the same result; an empty table gives an empty result;
other columns are ignored. At most MOST_LANGS languages can be learned; more raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.common import sliced

NGRAMS, BUCKETS = 4, 1 << 15
PER_LANG, LANDMARKS, RIDGE = 400, 256, 1e-2
MOST_LANGS = 500
UNKNOWN = "und"
_ROWS = 128


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    weights: np.ndarray  # BUCKETS x langs
    constant: np.ndarray  # BUCKETS: the fit of 1 for every learned row, which falls to 0 for text unlike all of them


def presence(text: str, out: np.ndarray) -> None:
    """Marks in out the places of the text's n-grams."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32) * np.uint32(0x9E3779B1)
    g = c
    for n in range(1, NGRAMS + 1):
        if n > 1:
            if len(c) < n:
                return
            g = g[:-1] * np.uint32(0x85EBCA6B) + c[n - 1 :]
        h = g ^ (g >> np.uint32(15))
        out[(h * np.uint32(0xC2B2AE35) + np.uint32(n)) >> np.uint32(17)] = 1


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def held_out(id_col: str) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        bits = []
        for text in b.column("text").to_pylist():
            row = np.zeros(BUCKETS, np.uint8)
            presence(text, row)
            bits.append(np.packbits(row).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("draw"), pa.array(bits, pa.binary())], ["lang", "draw", "bits"])


def sample(docs: DataFrame, per_lang: int, *, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, bits): at most per_lang labelled rows of each language that are not held out."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(text_col).isNotNull())
    counts = known.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("rows")).limit(MOST_LANGS + 1).collect()
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages to learn")
    rates = F.broadcast(docs.sparkSession.createDataFrame(counts, "lang string, rows long"))  # at most MOST_LANGS rows
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(17)), F.lit(1_000_000_007))
    drawn = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), draw.alias("draw")).join(rates, "lang")
    drawn = drawn.where(F.col("draw") * F.col("rows") <= F.lit(3 * per_lang + 50) * F.lit(1_000_000_007.0))  # some more than are taken
    bits = drawn.repartition(32, "draw").select("lang", "draw", "text").mapInArrow(_packed, "lang string, draw long, bits binary")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "bits"))
    return bits.withColumn("nth", first).where(F.col("nth") <= per_lang).select("lang", "bits", "nth")


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """The classifier; None if no row can be learned from."""
    rows = sample(docs, per_lang, id_col=id_col, text_col=text_col, lang_col=lang_col).toArrow().to_pandas()
    if not len(rows):
        return None
    rows = rows.sort_values(["nth", "lang"], kind="stable")
    langs = sorted(rows.lang.unique())
    bits = np.frombuffer(b"".join(rows.bits), np.uint8).reshape(len(rows), -1)

    def unit(part: np.ndarray) -> np.ndarray:
        x = np.unpackbits(part, axis=1).astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))

    marks = unit(bits[: max(landmarks, len(langs))])  # the first of every language in turn
    k = np.concatenate([unit(bits[i : i + _ROWS]) @ marks.T for i in range(0, len(bits), _ROWS)]).astype(np.float64)
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    x = k @ root
    y = np.where(rows.lang.to_numpy()[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    weight = 1.0 / (len(langs) * rows.groupby("lang").lang.transform("count").to_numpy())  # languages count alike
    gram = x.T @ (x * weight[:, None]) + ridge / len(langs) * np.eye(x.shape[1]) / max(1, len(bits))
    w, one = np.linalg.solve(gram, x.T @ (y * weight[:, None])), np.linalg.solve(gram, x.T @ weight)
    return Model(tuple(langs), (marks.T @ (root @ w)).astype(np.float32), (marks.T @ (root @ one)).astype(np.float32))


def _score(model: Model | None, support: bool):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = b.column("text").to_pylist()
            lang, value, held = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            able = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
            for at in range(0, len(able), _ROWS):
                part = able[at : at + _ROWS]
                x = np.zeros((len(part), BUCKETS), np.uint8)
                for r, i in enumerate(part):
                    presence(texts[i], x[r])
                x = x.astype(np.float32)
                root = np.sqrt(x.sum(axis=1, keepdims=True))
                f = (x @ model.weights) / root
                best = f.argmax(axis=1)
                if support:
                    held[part] = (f[np.arange(len(part)), best] + (x @ model.constant) / root[:, 0]) / 2
                value[part] = np.clip((1 + f[np.arange(len(part)), best].astype(np.float64)) / 2, 0, 1)
                for i, j in zip(part, best, strict=True):
                    lang[i] = model.langs[j]
            given = {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(value, pa.float64())} | ({"support": pa.array(held, pa.float64())} if support else {})
            keep = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in keep] + list(given.values()), keep + list(given))

    return score


def identify(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", support: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and the input row in the struct `row`.

    support: also the fit of a target that is 1 for the language's own rows and 0 for all others. Outputs of targets of
    -1 and 1 rise to 0 for text like none of the learned; support falls to 0 there.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    given = {"lang_pred": F.lit(""), "score": F.lit(0.0)} | ({"support": F.lit(0.0)} if support else {})
    schema = base.drop("text").withColumns(given).schema
    for f in schema.fields:
        f.nullable = True
    return base.mapInArrow(_score(model, support), schema)
