"""Members of ranked lists, day by day: a state machine per list over dated events.

A month begins with a ranking by what was traded before it: names that are well inside stay or come, members near the edge
stay, and the list is filled from the best. A member that stops printing in mid-month is replaced by the best of the month's
ranking that is neither a member nor silent. Rankings and silences are made by windows on each name's own bars; only they
(a row per name and month, and per silence), not bars, meet in a list's stream, which is read in order of time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.operators.joins import as_of
from ravelin.sources.store import kept

SEASON, QUIET, BAND = 90, 14, 1.5  # bars of the money that ranks; days without a bar that end a membership; how far members may fall


@dataclass(frozen=True)
class Spec:
    """A spelled list: all names of a base, or its n most traded."""

    base: str
    top: int | None = None


def spelled(name: str) -> Spec:
    """`base` or `base_topN`. A number without a base, or of none, is refused."""
    found = re.fullmatch(r"(.+?)(?:_top([1-9][0-9]*))?", name)
    if not name or not found or re.fullmatch(r"_?top[0-9]*", name) or re.search(r"_top0*$", name):
        raise ValueError(f"no list is spelled {name!r}")
    return Spec(found[1], int(found[2]) if found[2] else None)


def rankings(bars: DataFrame, season: int = SEASON, quiet: int = QUIET) -> DataFrame:
    """(list, month, instrument, rank): names that printed within `quiet` days before the month, by mean money of their last bars."""
    own = Window.partitionBy("list", "instrument").orderBy("ts")
    b = bars.select("list", "instrument", "ts", F.round(F.avg("dollar_volume").over(own.rowsBetween(1 - season, 0)), 4).alias("money"))
    last = b.groupBy("list", "instrument", (F.date_trunc("month", "ts") + F.expr("INTERVAL 1 MONTH")).alias("month")).agg(F.max("ts").alias("ts"), F.max_by("money", "ts").alias("money"))
    alive = last.where(F.col("ts") + F.make_interval(days=F.lit(quiet)) > F.col("month"))
    rank = F.row_number().over(Window.partitionBy("list", "month").orderBy(F.desc("money"), "instrument"))
    return alive.select("list", "month", "instrument", rank.alias("rank"))


def silences(bars: DataFrame, quiet: int = QUIET) -> DataFrame:
    """(list, instrument, start, end): from `quiet` days after a bar to the next one, null if there is none; as far as the list's bars go."""
    own = Window.partitionBy("list", "instrument").orderBy("ts")
    b = bars.select("list", "instrument", (F.col("ts") + F.make_interval(days=F.lit(quiet))).alias("start"), F.lead("ts").over(own).alias("end"))
    last = bars.groupBy("list").agg(F.max("ts").alias("last"))
    return b.where("end IS NULL OR end > start").join(F.broadcast(last), "list").where("start <= last").drop("last")  # a row per list


class Members:
    """One list, from moment to moment: a ranking's names in order, or names that fell silent, each with its end.

    It holds the names of the month and the last silence of each name, not their histories.
    """

    def __init__(self, name: str, n: int, band: float) -> None:
        self.name, self.n, self.core, self.edge = name, n, int(n / band), int(n * band)
        self.members, self.since, self.order, self.silent_to = [], {}, [], {}

    def turn(self, at: datetime, ranks: bool, group: list[tuple[str, datetime | None]]) -> list[tuple]:
        """Memberships that end at a moment."""
        if ranks:
            self.order = [x for x, _ in group]
            core = self.order[: self.core]
            new = (core + [x for x in self.order[len(core) : self.edge] if x in self.members])[: self.n]
            return self._become(new + list(islice((x for x in self.order if x not in new), self.n - len(new))), at)
        self.silent_to.update(group)
        gone = {x for x, _ in group}.intersection(self.members)
        if not gone:
            return []
        stay = [x for x in self.members if x not in gone]
        return self._become(stay + list(islice((x for x in self.order if x not in stay and not self._silent(x, at)), len(gone))), at)

    def rest(self) -> list[tuple]:
        """Memberships that last."""
        return [(self.name, x, self.since[x], None) for x in self.members]

    def _silent(self, x: str, at: datetime) -> bool:
        return x in self.silent_to and (self.silent_to[x] is None or self.silent_to[x] > at)

    def _become(self, new: list[str], at: datetime) -> list[tuple]:
        over = [(self.name, x, self.since.pop(x), at) for x in self.members if x not in new]
        self.since.update({x: at for x in new if x not in self.since})
        self.members = new
        return over


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    stamp = pa.timestamp("us", tz="UTC")
    columns = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), stamp, stamp), strict=True)], ["list", "instrument", "start", "end"])


def spans_of_members(bars: DataFrame, n: int, band: float = BAND, season: int = SEASON, quiet: int = QUIET) -> DataFrame:
    """(list, instrument, start, end) of memberships in each list's n; end is null while they last. bars: list, instrument, ts, dollar_volume."""
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    ranked = rankings(bars, season, quiet).select("list", "instrument", F.col("month").alias("at"), "rank", none("until", "timestamp"))
    silent = silences(bars, quiet).select("list", "instrument", F.col("start").alias("at"), none("rank", "int"), F.col("end").alias("until"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, machine = None, [], None
        for b in batches:
            out: list[tuple] = []
            for of, at, first, instrument, until in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (of, at, first) != now:
                    if now:
                        out.extend(machine.turn(now[1], now[2], group))
                        out.extend(machine.rest() if now[0] != of else ())
                    machine = Members(of, n, band) if not now or now[0] != of else machine
                    now, group = (of, at, first), []
                group.append((instrument, until))
            yield _spans(out)
        if now:
            yield _spans([*machine.turn(now[1], now[2], group), *machine.rest()])

    events = ranked.unionByName(silent).withColumn("first", F.col("rank").isNotNull())
    ordered = events.repartition("list").sortWithinPartitions("list", "at", "first", "rank", "instrument")
    return ordered.select("list", "at", "first", "instrument", "until").mapInArrow(run, "list string, instrument string, start timestamp, end timestamp")


def members_by_day(bars: DataFrame, spans: DataFrame) -> DataFrame:
    """(list, instrument, ts, listed) for every bar. Spans of one name don't overlap, so the last one begun decides."""
    key = F.concat_ws("\t", "list", "instrument").alias("key")
    asks, begun = bars.select("list", "instrument", "ts", key), spans.select(key, "start", "end")
    found = as_of(asks, begun, "key", "ts", "start", ["end"])
    listed = F.col("value_ts").isNotNull() & (F.col("end").isNull() | (F.col("ts") < F.col("end")))
    return found.select("list", "instrument", "ts", listed.alias("listed"))


def resolved(name: str, bars: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(bars of the list's names, their membership or None for all names at all times) of a spelled list. bars: list, instrument, ts, ..."""
    spec = spelled(name)
    own = kept(bars.where(F.col("list") == spec.base), "list")
    if own.isEmpty():
        raise ValueError(f"no list is named {spec.base!r}")
    if spec.top is None:
        return own.drop("list"), None
    return own.drop("list"), members_by_day(own, spans_of_members(own, spec.top)).drop("list")
