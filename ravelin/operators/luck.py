"""Whether a record is luck: block bootstrap, rotations, best of many tries, deflated ratios, paired tests.

Every replicate has a seed of its own, so a task that runs again gives the same figures. A record's days travel as one
array per key; replicates are dealt out in chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import erf, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.operators.metrics import TARGETS

YEAR = 365


def normal(z: Column) -> Column:
    """The normal distribution function as an expression, to about 1e-7 (a rational approximation of the tail)."""
    t = 1 / (1 + F.abs(z) * 0.2316419)
    c = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)  # fixed values of the approximation
    tail = F.exp(-z * z / 2) / F.lit(sqrt(2 * np.pi)) * t * (c[0] + t * (c[1] + t * (c[2] + t * (c[3] + t * c[4]))))
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def sharpe_of(x: np.ndarray, axis: int = -1) -> np.ndarray:
    sd = x.std(axis=axis, ddof=1)
    return np.where(sd > 0, x.mean(axis=axis) / np.where(sd > 0, sd, 1), 0.0) * sqrt(YEAR)


def block_length(x: np.ndarray) -> float:
    """Mean block of the stationary bootstrap by the automatic rule on a flat-top window."""
    n = len(x)
    x = x - x.mean()
    most = int(min(np.ceil(sqrt(n)) + max(5, np.log10(n)), n - 1))
    acv = np.array([np.dot(x[: n - k], x[k:]) / n for k in range(most + 1)])
    if acv[0] <= 0:
        return 1.0
    rho, bound, run = acv / acv[0], 2 * sqrt(np.log10(n) / n), max(5, int(sqrt(np.log10(n))))
    quiet = next((k for k in range(1, most - run + 2) if (np.abs(rho[k : k + run]) < bound).all()), most)
    m = min(2 * max(quiet - 1, 1), most)
    k = np.arange(1, m + 1)
    flat = np.where(k / m <= 0.5, 1.0, 2 * (1 - k / m))
    g = 2 * np.sum(flat * k * acv[k])
    lr = acv[0] + 2 * np.sum(flat * acv[k])
    return float(np.clip((2 * g * g / (2 * lr * lr)) ** (1 / 3) * n ** (1 / 3) if lr > 0 else 1.0, 1.0, max(1.0, min(3 * sqrt(n), n / 3, n / 4))))


def stationary(n: int, block: float, rng: np.random.Generator) -> np.ndarray:
    """Places of one resampled path: a new block begins with chance 1 / block."""
    new = rng.random(n) < 1 / block
    new[0] = True
    start, at = rng.integers(0, n, n), np.flatnonzero(new)
    since = np.arange(n) - np.repeat(at, np.diff(np.r_[at, n]))
    return (np.repeat(start[at], np.diff(np.r_[at, n])) + since) % n


def complete_months(day: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past last place of each whole calendar month of days in a row (days since 1970)."""
    dates = day.astype("datetime64[D]")
    month = dates.astype("datetime64[M]")
    first = np.flatnonzero(np.r_[True, month[1:] != month[:-1]])
    beyond = np.r_[first[1:], len(day)]
    whole = (beyond - first) == ((month[first] + 1).astype("datetime64[D]") - month[first].astype("datetime64[D]")).astype(int)
    return first[whole], beyond[whole]


def path_figures(x: np.ndarray, first: np.ndarray, beyond: np.ndarray) -> tuple[float, ...]:
    """FIGURES of a path; first and beyond are the places of its whole months."""
    total = np.r_[0.0, np.cumsum(np.log1p(np.maximum(x, -0.999999)))]
    equity = np.exp(total)
    months = np.expm1(total[beyond] - total[first])
    active = np.count_nonzero(np.abs(months) > 1e-15)
    average = equity[-1] ** (YEAR / 12 / len(x)) - 1 if len(months) else np.nan
    green = np.count_nonzero(months > 1e-15) / active if active else np.nan
    return float(average), float(green), float((equity / np.maximum.accumulate(equity) - 1).min()), float(sharpe_of(x)), float(months.min()) if len(months) else np.nan


FIGURES = ("avg_monthly", "green_active", "max_dd", "sharpe", "worst_month")
LEAST_DAYS, LEAST_BOOT = 30, 90  # fixed values: days that a test and a bootstrap ask for


def as_arrays(record: DataFrame, *values: str) -> DataFrame:
    """One row per key, its values in order of day: as long as a record, not as the table."""
    return record.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("day", *values))).alias("x")).select("key", *(F.col(f"x.{v}").alias(v) for v in values))


def replicated(arrays: DataFrame, reps: int, chunk: int, fn: Callable[..., dict[str, float]], schema: str, prepare: Callable[..., tuple] = lambda *x: x) -> DataFrame:
    """fn(*prepare(row's arrays), rng) for each replicate; prepare runs once per row and chunk. schema: fn's figures."""
    names = [c for c in arrays.columns if c != "key"]
    dealt = arrays.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(reps - 1), F.lit(chunk)))).repartition("key", "first")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                x = prepare(*(np.asarray(getattr(row, v), float) for v in names))
                yield pd.DataFrame([{"key": row.key, "rep": r} | fn(*x, np.random.default_rng([r, 97])) for r in range(row.first, min(row.first + chunk, reps))])

    return dealt.mapInPandas(run, f"key string, rep int, {schema}")


def monte_carlo(record: DataFrame, reps: int = 1000, chunk: int = 250) -> DataFrame:
    """(key, figure, p5, p50, p95) over resampled paths, and in p50 of two more figures how often a target is missed.

    Records of fewer than LEAST_BOOT days have none.
    """

    def prepare(day: np.ndarray, r: np.ndarray) -> tuple:
        return r, block_length(r), *complete_months(day.astype(np.int64))

    def one(r: np.ndarray, block: float, first: np.ndarray, beyond: np.ndarray, rng: np.random.Generator) -> dict[str, float]:
        return dict(zip(FIGURES, path_figures(r[stationary(len(r), block, rng)], first, beyond), strict=True))

    x = as_arrays(record.withColumn("n", F.datediff("day", F.lit("1970-01-01").cast("date")).cast("double")), "n", "r").where(F.size("r") >= LEAST_BOOT)
    paths = replicated(x, reps, chunk, one, ", ".join(f"{f} double" for f in FIGURES), prepare)
    missed = {"avg_monthly_missed": F.col("avg_monthly") < TARGETS["avg_monthly"], "max_dd_missed": F.col("max_dd") < TARGETS["max_dd"]}
    values = [F.struct(F.lit(f).alias("figure"), F.when(~F.isnan(f), F.col(f)).alias("v"), F.lit(False).alias("share")) for f in FIGURES]
    values += [F.struct(F.lit(f).alias("figure"), c.cast("double").alias("v"), F.lit(True).alias("share")) for f, c in missed.items()]
    long_ = paths.select("key", F.explode(F.array(*values)).alias("x")).select("key", "x.*")
    p = long_.groupBy("key", "figure", "share").agg(F.expr("percentile(v, array(0.05D, 0.5D, 0.95D))").alias("p"), F.avg("v").alias("mean"))
    at = lambda i: F.when(~F.col("share"), F.col("p")[i])
    return p.select("key", "figure", at(0).alias("p5"), F.when(F.col("share"), F.col("mean")).otherwise(F.col("p")[1]).alias("p50"), at(2).alias("p95"))


class Holdable:
    """A book's places that can be held, name after name, as flat arrays; bars x names come in as names x bars."""

    def __init__(self, w: np.ndarray, market: dict[str, np.ndarray], can: np.ndarray, rate: float, borrow: float) -> None:
        name, self.bar = np.nonzero(can)
        self.bars, self.rate, self.borrow = w.shape[1], rate, borrow
        self.weight, self.size = w[can], np.bincount(name, minlength=len(w))[name]
        self.first = np.r_[0, np.cumsum(np.bincount(name, minlength=len(w)))][name]
        self.place = np.arange(len(name)) - self.first
        self.follows = np.r_[False, (name[1:] == name[:-1]) & (self.bar[1:] == self.bar[:-1] + 1)]  # held on the bar before as well
        self.ends = ~np.r_[self.follows[1:], False] & (self.bar + 1 < self.bars)  # sold at the next open, with its gap
        self.earns = (market["session"] - market["funding"])[can]
        gap = np.c_[market["gap"][:, 1:], np.zeros(len(w))][can]
        self.later = np.where(self.bar + 1 < self.bars, gap, 0.0)

    def sharpe(self, fraction: float | None = None) -> float:
        """Of the daily net returns, with every name's weights turned by the fraction of its own places (None: as they are)."""
        turn = 0 if fraction is None else np.where(self.size > 1, 1 + (fraction * (self.size - 1)).astype(int), 0)
        x = self.weight[self.first + (self.place + turn) % self.size]
        change = np.abs(x - np.where(self.follows, np.r_[0.0, x[:-1]], 0.0))
        today = x * self.earns - change * self.rate - np.maximum(-x, 0) * self.borrow / YEAR
        after = x * self.later - np.where(self.ends, np.abs(x), 0.0) * self.rate
        total = np.bincount(self.bar, today, self.bars) + np.bincount(np.minimum(self.bar + 1, self.bars - 1), np.where(self.bar + 1 < self.bars, after, 0.0), self.bars)
        return float(sharpe_of(np.maximum(total, -0.999999)))


def random_timing(book: DataFrame, rotations: int = 500, chunk: int = 100, rate: float = 0.0005, borrow: float = 0.0, seed: int = 7) -> DataFrame:
    """(key, sharpe, null_median, null_p95, p): a book against itself with the timing of its positions turned.

    book: key, instrument, ts (days), weight held over the bar, gap (from the last close to the open), session (from open to
    close), funding paid by a long, and member (whether the list has the name). A name may be held where it printed and is
    a member, or where the book holds it. Books of fewer than LEAST_DAYS bars, or that hold nothing, have no row. A
    chunk of rotations of a book is a group.
    """
    fields = ["weight", "gap", "session", "funding", "member"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="instrument", columns="ts", values=fields).sort_index()
        x = {f: wide[f].to_numpy(float) for f in fields}
        printed, w = ~np.isnan(x["session"]), np.nan_to_num(x["weight"])
        held = (w != 0).any(axis=1)
        first, size = int(pdf["first"].iloc[0]), w.shape[1]
        if size < LEAST_DAYS or not held.any():
            return pd.DataFrame({"key": [], "own": [], "turned": []})
        can = (printed & ((np.nan_to_num(x["member"]) > 0) | (w != 0)))[held]
        market = {f: np.nan_to_num(x[f])[held] for f in ("gap", "session", "funding")}
        places = Holdable(w[held], market, can, rate, borrow)
        drawn = np.random.default_rng(seed).random(rotations)[first : first + chunk]
        return pd.DataFrame({"key": pdf["key"].iloc[0], "own": places.sharpe(), "turned": [places.sharpe(f) for f in drawn]})

    dealt = book.select("key", "instrument", "ts", *(F.col(f).cast("double").alias(f) for f in fields)).withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(rotations - 1), F.lit(chunk))))
    r = dealt.groupBy("key", "first").applyInPandas(one, "key string, own double, turned double")
    return r.groupBy("key").agg(
        F.max("own").alias("sharpe"), F.expr("percentile(turned, 0.5D)").alias("null_median"), F.expr("percentile(turned, 0.95D)").alias("null_p95"),
        ((1 + F.count_if(F.col("turned") >= F.col("own"))) / (1 + F.count(F.lit(1)))).alias("p"),
    )


def paired(record: DataFrame, block: float = 20.0, reps: int = 1000, chunk: int = 250) -> DataFrame:
    """(key, sharpe, sharpe_other, t): how far a's ratio lies over b's in deviations of the difference.

    record: key, day, a, b. Both are resampled together, so what they share cancels. Under LEAST_DAYS days there is no row.
    """

    def one(a: np.ndarray, b: np.ndarray, rng: np.random.Generator) -> dict[str, float]:
        at = stationary(len(a), block, rng)
        return {"own": float(sharpe_of(a)), "other": float(sharpe_of(b)), "draw": float(sharpe_of(a[at]) - sharpe_of(b[at]))}

    x = as_arrays(record.fillna(0.0, ["a", "b"]), "a", "b").where(F.size("a") >= LEAST_DAYS)
    r = replicated(x, reps, chunk, one, "own double, other double, draw double")
    edge = F.max("own") - F.max("other")
    return r.groupBy("key").agg(F.max("own").alias("sharpe"), F.max("other").alias("sharpe_other"), (edge / F.nullif(F.stddev_samp("draw"), F.lit(0.0))).alias("t"))


def expected_max(n: float) -> float:
    """Mean of the greatest of n standard normals."""
    if n <= 1:
        return 0.0
    x = np.linspace(-12, 12, 24001)
    cdf = 0.5 * (1 + np.vectorize(erf)(x / sqrt(2)))
    dens = np.exp(-x * x / 2) / sqrt(2 * np.pi)
    return float(np.trapezoid(x * n * dens * np.power(cdf, n - 1), x))


def deflated(record: DataFrame, trials: float) -> DataFrame:
    """(key, sharpe, bar, probability): whether a daily ratio beats the best of so many tries without merit."""
    best = expected_max(trials)
    m = record.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.skewness("r").alias("g1"), F.kurtosis("r").alias("g2"))
    sr, n = F.coalesce(F.col("mean") / F.nullif(F.col("sd"), F.lit(0.0)), F.lit(0.0)), F.col("n")
    skew = F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = ((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3))
    var = (1 - skew * sr + (kurt + 2) / 4 * sr * sr) / (n - 1)
    bar = F.lit(best) / F.sqrt(n - 1)

    return m.select("key", (sr * F.lit(sqrt(YEAR))).alias("sharpe"), (bar * F.lit(sqrt(YEAR))).alias("bar"), normal((sr - bar) / F.sqrt(var)).alias("probability"))


def pair_scores(record: DataFrame, least: int = 60) -> DataFrame:
    """(a, b, score): correlation on shared days, shrunk by the share of days that are shared. Pairs meet by day, once each."""
    x, y = record.select("day", F.col("key").alias("a"), F.col("r").alias("ra")), record.select("day", F.col("key").alias("b"), F.col("r").alias("rb"))
    n = record.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    c = x.join(y, "day").where("a < b").groupBy("a", "b").agg(F.corr("ra", "rb").alias("rho"), F.count(F.lit(1)).alias("shared"))
    c = c.join(n.withColumnsRenamed({"key": "a", "n": "na"}), "a").join(n.withColumnsRenamed({"key": "b", "n": "nb"}), "b")
    return c.select("a", "b", F.when(F.col("shared") < least, 0.0).otherwise(F.coalesce("rho", F.lit(0.0)) * F.col("shared") / F.sqrt(F.col("na") * F.col("nb"))).alias("score"))


DRAWS, BATCH = 20_000, 500
ONE_TRY = 1.6448536269514722  # fixed value: the one-sided 5 % point of a single try
ALL = "*"  # the row of all families together


def _multipliers(seed: int, family: str, batch: int, days: np.ndarray, known: dict) -> np.ndarray:
    """A normal number for each day (since 1970) and draw; the same wherever it is asked for, as each span of days has a seed."""
    out, span = np.empty((len(days), BATCH)), days // 256
    for s in np.unique(span):
        key = (family, batch, int(s))
        if key not in known:
            if len(known) > 64:
                known.clear()
            known[key] = np.random.default_rng([seed, batch, int(s) + 2**31, *family.encode()]).standard_normal((256, BATCH))
        here = span == s
        out[here] = known[key][days[here] % 256]
    return out


def best_of_draws(record: DataFrame, extra: int, draws: int, seed: int) -> DataFrame:
    """(family, draw, best, tries): the best score of each family in each draw of a world without merit.

    The multiplier bootstrap: a draw gives every day of a family one normal number, and a record's score is the mean of its
    standardised returns weighted with them, over its deviation. So scores are normal and correlate as the records do on the
    days that they share, times the share of days shared, and no pair of records is ever looked at. Families are independent.
    """
    day = F.datediff("day", F.lit("1970-01-01").cast("date")).alias("n")
    rows = record.select(F.coalesce(F.col("family").cast("string"), F.lit("")).alias("family"), F.col("key").cast("string").alias("key"), day, "r")
    each = rows.groupBy("family", "key").agg(F.array_sort(F.collect_list(F.struct("n", "r"))).alias("x"))
    dealt = each.select("family", F.col("x.n").alias("n"), F.col("x.r").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(-(-draws // BATCH) - 1))).alias("batch")).repartition("family", "batch", F.size("n") % 8)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for b in batches:
            for (family, batch), g in b.groupby(["family", "batch"]):
                best, at, numbers = np.full(BATCH, -np.inf), None, None
                for days, r in zip(g["n"], g["r"], strict=True):
                    x = np.asarray(r, float) - np.mean(r)
                    size = sqrt(float(x @ x))
                    if at is None or not np.array_equal(at, days):  # records of one grid have the same days
                        at = np.asarray(days, np.int64)
                        numbers = _multipliers(seed, family, int(batch), at, known)
                    best = np.maximum(best, (x / size if size > 0 else np.full(len(x), 1 / sqrt(len(x)))) @ numbers)
                yield pd.DataFrame({"family": [family], "batch": [batch], "best": [best], "tries": [len(g)]})

    found = dealt.mapInPandas(run, "family string, batch int, best array<double>, tries int")
    if extra:
        def unknown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for batch in b["id"]:
                    top = np.random.default_rng([seed, int(batch), 1]).random(BATCH) ** (1 / extra)  # of so many uniform numbers the greatest
                    yield pd.DataFrame({"family": [None], "batch": [batch], "best": [[NormalDist().inv_cdf(min(max(u, 1e-300), 1 - 1e-16)) for u in top]], "tries": [extra]})

        found = found.unionByName(record.sparkSession.range(-(-draws // BATCH)).mapInPandas(unknown, "family string, batch int, best array<double>, tries int"))
    flat = found.select("family", "batch", "tries", F.posexplode("best").alias("i", "best"))
    return flat.groupBy("family", (F.col("batch") * BATCH + F.col("i")).alias("draw")).agg(F.max("best").alias("best"), F.sum("tries").alias("tries")).where(F.col("draw") < draws)


def luck_of(record: DataFrame, extra: int = 0, draws: int = DRAWS, seed: int = 7) -> DataFrame:
    """(family, tries, independent, best_95): a row per family, and one of all (ALL), from the same draws.

    record: family, key, day, r. extra: tries whose records aren't known, independent of everything, which only ALL counts.
    independent: how many independent tries have a best that is as good on average; best_95: what the best reaches by
    luck one time in twenty (a familywise test by the greatest statistic).
    """
    best = best_of_draws(record, extra, draws, seed)
    whole = best.groupBy("draw").agg(F.max("best").alias("best"), F.sum("tries").alias("tries")).withColumn("family", F.lit(ALL))
    rows = best.where("family IS NOT NULL").unionByName(whole.select(best.columns))
    made = rows.groupBy("family").agg(F.max("tries").cast("int").alias("tries"), F.avg("best").alias("mean"), F.expr("percentile(best, 0.95D)").alias("best_95"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            one = b["tries"] < 2
            b["independent"] = [1.0 if o else as_independent(m, n) for o, m, n in zip(one, b["mean"], b["tries"], strict=True)]
            b["best_95"] = b["best_95"].where(~one, ONE_TRY)
            yield b[["family", "tries", "independent", "best_95"]]

    return made.mapInPandas(count, "family string, tries int, independent double, best_95 double")


def as_independent(mean: float, n: int) -> float:
    """How many independent tries, n at most, have a best that is no better on average."""
    lo, hi = 1, max(n, 2)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if expected_max(mid) <= mean else (lo, mid - 1)
    return float(lo)


def at_target_drawdown(record: DataFrame, wanted: float = -0.1) -> DataFrame:
    """(key, multiple, growth): how much of the record gives the wanted greatest drawdown, by halving."""

    def one(r: np.ndarray, _: np.random.Generator) -> dict[str, float]:
        def worst(k: float) -> float:
            eq = np.cumprod(np.maximum(1 + k * r, 1e-9))
            return float((eq / np.maximum(np.maximum.accumulate(eq), 1) - 1).min())

        lo, hi = 0.0, 64.0
        if worst(hi) >= wanted:
            lo = hi
        for _i in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if worst(mid) >= wanted else (lo, mid)
        return {"multiple": lo, "growth": float(np.prod(np.maximum(1 + lo * r, 1e-9)))}

    return replicated(as_arrays(record, "r"), 1, 1, one, "multiple double, growth double").drop("rep")
