"""Exits inside bars: a walk on two clocks, bars for decisions and minutes for prices.

Minutes are joined to the bars that they lie in and come before them in one ordered stream per instrument, so a worker
holds the minutes of one bar and the state of one position per variant (a signal with its exits), never an instrument's
history. A bar without minutes is walked on its own prices. All variants go through a minute together, as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.operators.joins import next_bar, stacked
from ravelin.operators.walks import Exits


class Positions:
    """Positions of one instrument in all variants, bar by bar."""

    def __init__(self, rules: list[Exits], every_minute: list[bool]) -> None:
        n = len(rules)
        far = lambda name: np.array([np.nan if (v := getattr(r, name)) is None else v for r in rules], float)
        self.rule = {f.name: far(f.name) for f in fields(Exits)}
        self.each = np.array(every_minute, bool)
        self.now, self.barred = np.zeros(n), np.zeros(n)
        self.entry, self.best, self.unit = np.full(n, np.nan), np.full(n, np.nan), np.full(n, np.nan)

    def _levels(self, atr: float) -> tuple[np.ndarray, np.ndarray]:
        """The nearest stop and the nearest take of each position, times its side: a fall to the one or a rise to the other leaves."""
        r, side = self.rule, self.now
        stops = [self.entry * (side - r["stop"]), side * self.entry - r["stop_atr"] * self.unit, self.best * (side - r["trail"]), side * self.best - r["trail_atr"] * atr]
        takes = [self.entry * (side + r["take"]), side * self.entry + r["take_atr"] * self.unit]
        return np.fmax.reduce(stops), np.fmin.reduce(takes)

    def bar(self, want: np.ndarray, o: float, h: float, lo: float, atr: float, ticks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(exit price, place of the tick it fell in, side held) after a bar. want: the sides decided before it; atr: as known then.

        ticks: open, high and low of the minutes inside, or of the bar alone.
        """
        self.barred = np.where(want == self.barred, self.barred, 0.0)
        want = np.where(self.barred != 0, 0.0, want)
        turned = want != self.now
        self.entry, self.best = np.where(turned, o, self.entry), np.where(turned, o, self.best)
        self.unit, self.now = np.where(turned, atr, self.unit), want
        held, px, at = want.copy(), np.full(len(want), np.nan), np.full(len(want), -1)
        for i, (first, top, bottom) in enumerate(ticks if self.now.any() else ()):
            stop, take = self._levels(atr)
            side = self.now
            opened, worst, dearest = first * side, np.where(side > 0, bottom, -top), np.where(side > 0, top, -bottom)
            stopped = (side != 0) & (worst <= stop)
            gained = (side != 0) & ~stopped & (dearest >= take)
            out = np.where(stopped, np.fmin(opened, stop), np.where(gained, np.fmax(opened, take), np.nan))
            gone = stopped | gained
            px, at = np.where(gone, out * side, px), np.where(gone, i, at)
            self.barred, self.now = np.where(gone, side, self.barred), np.where(gone, 0.0, side)
            self._reach(self.each, top, bottom)
        self._reach(~self.each if len(ticks) else np.ones(len(want), bool), h, lo)
        return px, at, held

    def _reach(self, which: np.ndarray, top: float, bottom: float) -> None:
        far = np.where(self.now > 0, np.fmax(self.best, top), np.fmin(self.best, bottom))
        self.best = np.where(which & (self.now != 0), far, self.best)


_OUT = "instrument string, ts timestamp, variant int, exit_px double, exit_at timestamp, held double"


def exits_inside(bars: DataFrame, minutes: DataFrame | None, rules: list[Exits], every: list[str]) -> DataFrame:
    """(instrument, ts, variant, exit_px, exit_at, held) of every bar over which a variant held a position.

    bars: instrument, ts, open, high, low, atr (as known at the bar's close) and sides, one wanted side per variant, decided
    at the close. minutes: instrument, ts (their close), open, high, low; a bar's are those after the bar before it, at or
    before its own close. every: bar or minute, how often a variant's trailing stop is set anew. exit_at is the start of the
    minute that left, null where the bar's own prices were walked.
    """
    price = lambda *c: [F.col(x).cast("double").alias(x) for x in c]
    none = F.lit(None)
    rows = bars.select("instrument", F.col("ts").alias("bar"), "ts", F.lit(1).alias("kind"), *price("open", "high", "low", "atr"), F.col("sides").cast("array<double>").alias("sides"))
    if minutes is not None:
        inside = next_bar(minutes, bars, "instrument", "ts", ["open", "high", "low"]).where("bar_ts IS NOT NULL")
        rows = stacked(rows, inside.select("instrument", F.col("bar_ts").alias("bar"), "ts", F.lit(0).alias("kind"), *price("open", "high", "low"), none.cast("double").alias("atr"), none.cast("array<double>").alias("sides")))
    count, each = len(rules), [e == "minute" for e in every]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state, ticks, starts, before = None, None, [], [], None
        for b in batches:
            out: list[tuple] = []
            for instrument, _, ts, kind, o, h, lo, atr, sides in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if instrument != name:
                    name, state, ticks, starts, before = instrument, Positions(rules, each), [], [], None
                if kind == 0:
                    ticks.append((o, h, lo))
                    starts.append(ts)
                    continue
                if o is not None and before is not None:
                    px, at, held = state.bar(before[0], o, h, lo, before[1], np.array(ticks or [(o, h, lo)], float))
                    for v in np.flatnonzero(held != 0).tolist():
                        left = not np.isnan(px[v])
                        out.append((name, ts, v, float(px[v]) if left else None, starts[at[v]] - MINUTE if left and ticks else None, float(held[v])))
                ticks, starts = [], []
                if sides is not None:
                    before = (np.nan_to_num(np.array([np.nan if s is None else s for s in sides])), np.nan if atr is None else atr)
            for lo_ in range(0, len(out), 20_000):
                cols = list(zip(*out[lo_ : lo_ + 20_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["instrument", "ts", "variant", "exit_px", "exit_at", "held"])

    from datetime import timedelta

    MINUTE, stamp = timedelta(minutes=1), pa.timestamp("us", tz="UTC")
    kinds = [pa.string(), stamp, pa.int32(), pa.float64(), stamp, pa.float64()]
    if count == 0:
        return bars.sparkSession.createDataFrame([], _OUT)
    return rows.repartition("instrument").sortWithinPartitions("instrument", "bar", "kind", "ts").mapInArrow(run, _OUT)
