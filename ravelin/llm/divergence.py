"""Source divergence audit: how far apart the sources of a language are in the terms that they use.

A term that many documents of a language hold is a row of nonzero counts by source. Pairs of sources are compared by the
sum of |p - q| over all kept terms, which is made of: what a pair would differ in if it held no term, what each source's
own counts change in it (by count and multiplicity), and a correction for terms that both hold. The corrections come
from a frequent-pattern tree: rows, their sources ordered by size, are inserted as paths with multiplicities; a path's
prefix that many terms share is one chain of nodes, and each node adds its correction to each of its ancestors once,
times its multiplicity. Paths are dealt by ranges, so that alike ones meet and no language or prefix is one task's; within a
task they come in order, so only one path's nodes are held.

All arithmetic is on whole numbers; what could pass 64 bits is decimal. A row, a path and a source's list of partners are
as long as a language has sources; the result has a row for each ordered pair of them.

Defined results: null text, lang and source are empty strings; a very long text is counted whole, and so is a very long
term; ties are ordered by the item's bytes; repeated rows count as often as they come; a language without kept terms has
pairs of value 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.common import encoded, kept_table, salt, sliced

LEAST_DOCS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50

_LETTERS = bytes(b if b >= 0x80 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_COUNTED = "lang string, source string, term string, occurrences long, docs long"
_HELD = 300_000  # counts that a task holds before it passes them on


def terms_of(data: bytes) -> list[bytes]:
    """Runs of ASCII letters and bytes of other characters, A-Z lower-cased."""
    return data.translate(_LETTERS).lower().split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (occ, docs) in held.items():
            n = len(occ)
            terms = pa.array(occ, pa.large_binary()).view(pa.large_string()).cast(pa.string())
            given = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), terms, pa.array(occ.values(), pa.int64()), pa.array([docs[t] for t in occ], pa.int64())]
            batch = pa.RecordBatch.from_arrays(given, ["lang", "source", "term", "occurrences", "docs"])
            yield from (batch.slice(i, 50_000) for i in range(0, n, 50_000))
        held.clear()

    for b in batches:
        for part in sliced(iter([b])):
            for lang, source, data in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), encoded(part.column("text")), strict=True):
                words = terms_of(data)
                occ, docs = held.setdefault((lang, source), (Counter(), Counter()))
                occ.update(words)
                docs.update(set(words))
            if sum(len(x) for x, _ in held.values()) > _HELD:
                yield from out()
    yield from out()


def _share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (n + PRIOR * v)), exactly; null where v is 0."""
    over, under = (F.lit(SCALE).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(24,0)")), F.nullif(n + PRIOR * v, F.lit(0)).cast("decimal(24,0)")
    return (F.call_function("div", over, under) + 1).cast("long")


def _tree(flush: int = 2000):
    """Paths in order to sums of corrections (a, b, value) and to counts of each source's shares (a, p, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []  # nodes of the last path: (source, count), index, p, z, multiplicity
        index: dict[str, int] = {}
        sums: dict[int, np.ndarray] = {}
        shares: Counter = Counter()
        lang = None

        def pop() -> None:
            _, i, p, z, times = stack.pop()
            shares[i, p] += times
            if stack:
                stack[-1][4] += times
                at, ps, zs = (np.array([s[k] for s in stack]) for k in (1, 2, 3))
                row = sums.setdefault(i, np.zeros(flush, np.int64))
                row[at] += times * (np.abs(p - ps) - np.abs(p - zs) - np.abs(z - ps) + abs(z - zs))

        def out() -> Iterator[pa.RecordBatch]:
            while stack:
                pop()
            names = list(index)
            rows = [(lang, names[i], names[j], None, int(row[j])) for i, row in sums.items() for j in np.flatnonzero(row)]
            rows += [(lang, names[i], None, p, n) for (i, p), n in shares.items()]
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            for lo in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[lo : lo + 50_000], strict=True), kinds, strict=True)], ["lang", "a", "b", "p", "value"])
            index.clear()
            sums.clear()
            shares.clear()

        for b in batches:
            for own, path, times in zip(*(b.column(c).to_pylist() for c in ("lang", "path", "times")), strict=True):
                full = len(index) + len(path) > flush or len(shares) > _HELD or len(sums) * flush > 1 << 24
                if own != lang or full:
                    yield from out()
                    lang = own
                same = 0
                while same < min(len(stack), len(path)) and stack[same][0] == (path[same]["source"], path[same]["count"]):
                    same += 1
                while len(stack) > same:
                    pop()
                for x in path[same:]:
                    stack.append([(x["source"], x["count"]), index.setdefault(x["source"], len(index)), x["p"], x["z"], 0])
                stack[-1][4] += times
        yield from out()

    return run


def audit(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP,
) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source the distance to each other one of its language, and its most excessive terms."""
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_col, lang_col, source_col))
    base = docs.select(lang.alias("lang"), source.alias("source"), text.alias("text"))
    counts = base.mapInArrow(_counted, _COUNTED).groupBy("lang", "source", "term").agg(F.sum("occurrences").alias("count"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total"), F.collect_list(F.struct("source", "count")).alias("held"))
    terms = kept_table(terms.where(F.col("docs") >= least_docs).select("lang", "term", "total", "held"), "terms")
    items = terms.select("lang", "term", "total", F.explode("held").alias("x")).select("lang", "term", "total", "x.source", "x.count")

    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("ln"))
    sizes = items.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    zero = F.lit(0).cast("long")
    groups = base.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("n", "v", "ln")))
    groups = kept_table(groups.withColumn("z", F.coalesce(_share(F.lit(0), F.col("n"), F.col("v")), zero)), "groups")

    items = items.join(groups, ["lang", "source"])
    items = kept_table(items.withColumns({"p": _share(F.col("count"), F.col("n"), F.col("v")), "q": _share(F.col("total"), F.col("ln"), F.col("v"))}), "items")

    over = items.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = over.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)  # limited before the shuffle as well
    return distances(items, groups).withColumn("rank", F.row_number().over(ranked)).unionByName(over)


def distances(items: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, part, item, value) for every ordered pair of a language's sources."""
    path = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("size"), "source", "count", "p", "z")))
    paths = items.groupBy("lang", "term").agg(path.alias("path")).groupBy("lang", "path").agg(F.count(F.lit(1)).alias("times"))
    head = F.transform(F.slice("path", 1, 4), lambda x: F.struct(x["size"], x["source"], x["count"]))  # so that a sample of ranges stays small
    dealt = paths.repartitionByRange("lang", head, F.xxhash64("path")).sortWithinPartitions("lang", "path")
    tree = kept_table(dealt.mapInArrow(_tree(), "lang string, a string, b string, p long, value long"), "tree")
    both = tree.where("b IS NOT NULL").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    shares = tree.where("b IS NULL").groupBy("lang", "a", "p").agg(F.sum("value").alias("times"))

    salts = 1 + (groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0) // 1000
    one = groups.select("lang", F.col("source").alias("a"), F.col("z").alias("za"), "v", salt("source", n=salts).alias("s"))
    other = groups.select("lang", F.col("source").alias("b"), F.col("z").alias("zb"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s"))
    pairs = one.join(other, ["lang", "s"]).where("a <> b").select("lang", "a", "b", "za", "zb", "v")

    # for every source the shares of its terms up to each other source's share of an absent term: running sums
    asked = pairs.select("lang", "a", F.col("zb").alias("p"), F.lit(1).alias("ask"), "b", "za", F.lit(0).cast("long").alias("times"))
    given = shares.select("lang", "a", "p", F.lit(0).alias("ask"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("long").alias("za"), "times")
    upto = Window.partitionBy("lang", "a").orderBy("p", "ask").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("lang", "a").orderBy("p", "ask").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    m, mp = F.col("times"), F.col("times") * F.col("p")
    run = asked.unionByName(given).select("*", F.sum(m).over(upto).alias("ml"), F.sum(mp).over(upto).alias("sl"), F.sum(m).over(whole).alias("ma"), F.sum(mp).over(whole).alias("sa"))
    own = F.expr("p * (2 * ml - ma) + sa - 2 * sl - ma * abs(za - p)")  # sum of |share - p| over its terms, less that of as many absent ones
    own = run.where("ask = 1").select("lang", "a", "b", own.alias("value"))
    neither = pairs.select("lang", "a", "b", F.expr("v * abs(za - zb)").alias("value"))
    swapped = [x.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value") for x in (own, both)]
    summed = neither.union(own.select(neither.columns)).union(both.select(neither.columns)).union(swapped[0]).union(swapped[1]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    return summed.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
