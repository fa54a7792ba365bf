"""Personal data: patterns of context, bootstrapped from identifiers that rules find.

Rules find e-mail and IP addresses, card and phone numbers: the seeds. Every other number and everything that only
resembles an identifier (another separator, a broken check digit, an `[at]`) is an instance without a kind. Words beside
an instance make its lexical patterns. Spark scores the graph of patterns and instances in rounds: a pattern's
confidence in a kind is the share of its distinct instances, known or not, that are of it, one made-up stranger added, and
counts only from `least_seeds` on; an unknown instance that resembles the kind is believed by its patterns together
(1 - product of their doubts) if one of them is good. Believed instances count as known in the next round. In the end all
occurrences of believed or seeded values that resemble their kind become spans, wherever they stand.

A value counts once per pattern, so copies of a text don't make a pattern good. Edges are distinct (pattern, value) pairs,
aggregated before they are shuffled; nothing is collected but whether a round found anything.

Defined results: a null text is an empty one and has no spans; a very long text is looked through whole, in time that
grows with its length alone; spans of one place are ordered by kind; rows with one id are looked through one by one; an
empty table gives an empty result; other columns are ignored. An added span never overlaps another span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import kept_table, sliced

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
LEAST_SEEDS, LEAST_CONFIDENCE, ROUNDS = 5, 0.8, 3

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*$")
_BEFORE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_QUAD = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")

_AT = re.compile(r"@|\x20?[\[({][aA][tT][\])}]\x20?")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({][dD][oO][tT][\])}]\x20?)[A-Za-z0-9-]++)*+")
_HEX = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Za-z:])")
_NUMBER = re.compile(r"[0-9]{7,}+|[0-9]{1,6}(?:(?:[\x20().-]{1,2}|\[\.\])[0-9]{1,6}(?![0-9]))*+|[0-9]++")
_BLUR = str.maketrans("123456789", "000000000")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, from each @ outwards: a run before it is read once."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _BEFORE:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
            free = found.end()
        at = text.find("@", max(free, at + 1))
        free = max(free, begin if not found else free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the rules find, ordered."""
    out = [(lo, EMAIL, hi) for lo, hi in _emails(text)]
    for m in _QUAD.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            out.append((m.start(), IP, m.end()))
    for m in _CHAIN.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), CARD, m.end()))
    for m in _PLUS.finditer(text):
        if 9 <= len(_DIGITS.sub("", m.group())) <= 15:
            out.append((m.start(), PHONE, m.end()))
    return sorted(out)


def _resembles(text: str) -> Iterator[tuple[int, int, int, str]]:
    """(start, end, kinds that it may be as bits, value) of everything that is a number or resembles an identifier."""
    for m in _AT.finditer(text):
        local, host = _LOCAL.search(text[max(0, m.start() - 64) : m.start()]), _HOST.match(text, m.end())
        if local.group() and host and len(host.group()) <= 255:
            value = re.sub(r"\x20?[\[({]dot[\])}]\x20?", ".", f"{local.group()}@{host.group()}".lower())
            yield m.start() - len(local.group()), host.end(), 1 << EMAIL, value
    for m in _HEX.finditer(text):
        yield m.start(), m.end(), 1 << IP, m.group().lower()
    for m in _NUMBER.finditer(text):
        digits, parts = _DIGITS.sub("", m.group()), re.split(r"\.|\[\.\]", m.group())
        n, quad = len(digits), len(parts) == 4 and all(p.isdigit() and int(p) <= 255 for p in parts)
        kinds = (1 << IP) if quad else (1 << CARD) * (12 <= n <= 19) | (1 << PHONE) * (7 <= n <= 15)
        yield m.start(), m.end(), kinds, ".".join(parts) if quad else digits


def value_of(text: str, kind: int) -> str:
    return text.lower() if kind == EMAIL else text if kind == IP else _DIGITS.sub("", text)


def context_patterns(text: str, lo: int, hi: int) -> list[str]:
    """The words beside a place, as patterns: three and two words before it, one on each side, and a cue such as `tel:` alone."""
    before = ["^", "^", "^", *text[max(0, lo - 80) : lo].lower().translate(_BLUR).split()][-3:]
    behind = [*text[hi : hi + 40].lower().translate(_BLUR).split()[:1], "$"][0]
    out = ["3\t" + "\t".join(before), "2\t" + "\t".join(before[1:]), f"1\t{before[2]}\t{behind}"]
    return out + ["0\t" + before[2]] * (before[2][-1:] in (":", "=", "#"))


def instances(text: str, base: list[tuple[int, int, int]]) -> list[tuple]:
    """(start, end, kinds as bits, seed: 0 or its kind + 1, value, patterns) of seeds and of what else is a number or resembles an identifier."""
    out = [(lo, hi, 0, kind + 1, f"{kind}:{value_of(text[lo:hi], kind)}", context_patterns(text, lo, hi)) for lo, kind, hi in base]
    taken, at, free = base, 0, 0
    for lo, hi, kinds, value in sorted(_resembles(text), key=lambda x: (x[0], -x[1])):
        while at < len(taken) and taken[at][0] < hi:
            free, at = max(free, taken[at][2]), at + 1
        if lo >= free:
            out.append((lo, hi, kinds, 0, value, context_patterns(text, lo, hi)))
            free = hi
    return out


def _hash(text: str) -> int:
    import xxhash

    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _keys(kinds: int, seed: int, value: str) -> list[int]:
    """A hash per kind that the value may be of; of a mere number one."""
    return [_hash(value)] if seed else [_hash(f"{k}:{value}") for k in range(4) if kinds >> k & 1] or [_hash(value)]


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_FOUND = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kinds", pa.int32()), ("seed", pa.int32()), ("keys", pa.list_(pa.int64())), ("patterns", pa.list_(pa.int64()))])
_MARKED = (
    "rid long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start:long,kind:int,end:long>>, "
    "found array<struct<start:long,end:long,kinds:int,seed:int,keys:array<long>,patterns:array<long>>>"
)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        counts, digests, bases, founds = ([], [], [], []), [], [], []
        for text in b.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            for k in range(4):
                counts[k].append(sum(s[1] == k for s in base))
            digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{lo}:{hi}" for lo, k, hi in base).encode()).hexdigest())
            bases.append([{"start": lo, "kind": k, "end": hi} for lo, k, hi in base])
            founds.append([
                {"start": lo, "end": hi, "kinds": kinds, "seed": seed, "keys": _keys(kinds, seed, value), "patterns": [_hash(p) for p in patterns]}
                for lo, hi, kinds, seed, value, patterns in instances(text, base)
            ])
        yield pa.RecordBatch.from_arrays(
            [b.column("rid"), b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(bases, pa.list_(_SPAN)), pa.array(founds, pa.list_(_FOUND))],
            ["rid", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "found"],
        )


def _kind_of(kinds: str, nth: str) -> str:
    """SQL: the kind that the nth key of an instance belongs to."""
    return f"element_at(filter(array(0, 1, 2, 3), k -> shiftright({kinds}, k) % 2 = 1), {nth} + 1)"


def identifiers(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_seeds: int = LEAST_SEEDS, least_confidence: float = LEAST_CONFIDENCE, rounds: int = ROUNDS,
) -> DataFrame:
    """One row per input row: counts and digest of what the rules find, and all spans, with those that context adds (n_added)."""
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = kept_table(base.mapInArrow(_mark, _MARKED), "marked")
    found = marked.select("rid", F.explode("found").alias("x")).select("rid", "x.*")
    places = found.select("rid", "start", "end", "kinds", "seed", F.posexplode("keys").alias("nth", "key"), "patterns")
    kind = F.when(F.col("seed") > 0, F.col("seed") - 1).when(F.col("kinds") > 0, F.expr(_kind_of("kinds", "nth")))
    places = places.withColumn("kind", kind)
    # an instance that may be of two kinds is one instance of a pattern: its first key stands for it
    edges = places.select(F.explode("patterns").alias("pattern"), "key", "kind", "seed", "nth").groupBy("pattern", "key")
    edges = kept_table(edges.agg(F.max("kind").alias("kind"), F.max("seed").alias("seed"), F.min("nth").alias("nth")), "edges")

    known = kept_table(places.where("seed > 0").select("key", "kind").distinct().withColumn("belief", F.lit(1.0)), "known")
    size = edges.groupBy("pattern").agg(F.sum(F.when(F.col("nth") == 0, 1).otherwise(0)).alias("size"))
    believed = known
    for _ in range(rounds):
        # a seed counts where its own edge is one or where its value stands in another form
        positive = edges.where("kind IS NOT NULL").join(believed.select("key", "belief"), "key").groupBy("pattern", "kind").agg(F.sum("belief").alias("positive"))
        good = positive.where(F.col("positive") >= least_seeds).join(size, "pattern").withColumn("trust", F.col("positive") / (F.col("size") + 1))
        good = good.where(F.col("trust") >= least_confidence).select("pattern", "kind", "trust")
        unknown = edges.where("seed = 0 AND kind IS NOT NULL").join(good, ["pattern", "kind"]).groupBy("key", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("trust"))))).alias("belief"))
        fresh = kept_table(unknown.join(known.select("key"), "key", "left_anti"), "believed")
        if fresh.isEmpty():
            break
        believed = known.unionByName(fresh.select("key", "kind", "belief"))
    seen = places.where("seed = 0 AND kind IS NOT NULL").join(believed, ["key", "kind"])
    best = seen.groupBy("rid", "start", "end").agg(F.max(F.struct("belief", (-F.col("kind")).alias("other"), "kind")).alias("m"))
    added = best.groupBy("rid").agg(F.collect_list(F.struct("start", F.col("m.kind").alias("kind"), "end")).alias("added"))
    out = marked.drop("found").join(added, "rid", "left")
    none = F.expr("cast(array() AS array<struct<start:long,kind:int,end:long>>)")
    all_spans = F.array_sort(F.concat("base", F.coalesce("added", none)))
    names = F.array(*map(F.lit, KINDS))
    said = F.array_join(F.transform(all_spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    n_added = F.coalesce(F.size("added"), F.lit(0)).cast("long")
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", said.alias("spans"), F.when(F.col("added").isNull(), F.lit(0).cast("long")).otherwise(n_added).alias("n_added"))
