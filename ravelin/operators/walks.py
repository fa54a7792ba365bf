"""Sequential simulations in numpy: the account, intrabar exits, buy and hold, seats and slots.

State couples all instruments of a book at a bar, so a book is one ordered pass; books (jobs, configurations) run in
parallel as groups. Arrays are bars x instruments.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


@dataclass
class Costs:
    """Rates per unit traded, yearly borrow of shorts, and length of a bar in years."""

    rate: float = 0.0005
    borrow: float = 0.0
    years: float = 1 / 365


@dataclass
class Account:
    net: np.ndarray
    gross: np.ndarray
    cost: np.ndarray
    carry: np.ndarray
    turnover: np.ndarray
    exposure: np.ndarray
    unfunded: np.ndarray
    weights: np.ndarray
    liquidated: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))


def forward(x: np.ndarray, start: float = np.nan) -> np.ndarray:
    """Last values down each column."""
    at = np.where(np.isnan(x), -1, np.arange(len(x))[:, None])
    at = np.maximum.accumulate(at, axis=0)
    out = np.take_along_axis(x, np.maximum(at, 0), axis=0)
    return np.where(at < 0, start, out)


def nearest(quoted: np.ndarray, flat: float) -> np.ndarray:
    """Rates by bar and name: a missing one is that of the nearest bar that has one, the earlier of two as near; without any, flat."""
    n = len(quoted)
    row, has = np.arange(n)[:, None], ~np.isnan(quoted)
    last = np.maximum.accumulate(np.where(has, row, -n), axis=0)
    following = np.minimum.accumulate(np.where(has, row, 2 * n)[::-1], axis=0)[::-1]
    at = np.where(row - last <= following - row, last, following)
    return np.where(has.any(axis=0), np.take_along_axis(quoted, np.clip(at, 0, n - 1), axis=0), flat)


def account(
    opn: np.ndarray, high: np.ndarray, close: np.ndarray, target: np.ndarray, costs: Costs, *, book: np.ndarray | None = None,
    exit_px: np.ndarray | None = None, funding: np.ndarray | None = None, dividend: np.ndarray | None = None, quoted: np.ndarray | None = None,
) -> Account:
    """Weights decided at a close are filled at the next open and held in units.

    book: bars at which the whole book is filled anew (a panel strategy); without it each instrument trades when its own
    target changes. exit_px: a price at which a position leaves within the bar. funding: what a long pays on its value at
    the bar's close; dividend: paid per unit of the previous close. quoted: a rate per bar and name at the open; where it
    is missing the nearest one of the name counts, before it its first, and without any the flat rate. A short that
    doubles is liquidated at twice its entry.
    """
    n, m = close.shape
    out = {k: np.zeros(n) for k in ("net", "gross", "cost", "carry", "turnover", "exposure", "unfunded")}
    weights, gone = np.zeros((n, m)), np.zeros((n, m), bool)
    target = np.nan_to_num(forward(target, 0.0))
    if np.abs(target).sum(axis=1).max(initial=0) > 1 + 1e-9:
        raise ValueError("targets over the whole equity")
    known, printed = forward(close), ~np.isnan(opn) & ~np.isnan(close)
    rates = np.full((n, m), costs.rate) if quoted is None else nearest(quoted, costs.rate)
    w, entry, done = np.zeros(m), np.full(m, np.nan), np.zeros(m)  # done: the target last filled
    for t in range(1, n):
        ok = printed[t] & ~np.isnan(known[t - 1])
        base = np.where(ok, known[t - 1], 1.0)
        gap = np.where(ok, opn[t] / base - 1, 0.0)
        level = 2 * entry
        burst = ok & (w < 0) & (opn[t] >= level)
        gap = np.where(burst, level / base - 1, gap)
        paid = float(np.sum(w * dividend[t] / base)) if dividend is not None else 0.0
        grow = 1 + float(np.sum(w * gap))
        pre = np.where(burst, 0.0, w * (1 + gap) / grow)
        cost = float(np.sum((np.abs(w * (1 + gap) / grow) * rates[t])[burst]))
        gone[t] |= burst
        due = ok & ((target[t - 1] != done) if book is None else book[t - 1])
        want = np.where(due, target[t - 1], pre)
        done = np.where(due, target[t - 1], np.where(burst, done, done))
        grows = (np.abs(want) > np.abs(pre)) | (want * pre < 0)
        added = np.where(grows, np.where(want * pre < 0, np.abs(want), np.abs(want) - np.abs(pre)), 0.0)
        kept = np.where(grows, np.where(want * pre < 0, 0.0, np.abs(pre)), np.abs(want))
        total = added.sum()
        if total > 0 and kept.sum() + total > 1:
            scale = max(1 - kept.sum(), 0.0) / total
            out["unfunded"][t] = total * (1 - scale)
            want = np.where(grows, np.sign(want) * (np.where(want * pre < 0, 0.0, np.abs(pre)) + added * scale), want)
        filled = np.abs(want - pre)
        short = want < 0
        if short.any():
            more = short & (np.abs(want) > np.abs(np.minimum(pre, 0)) + 1e-15)
            held = np.abs(np.minimum(pre, 0))
            new_entry = np.where(held > 0, (held * np.nan_to_num(entry) + (np.abs(want) - held) * np.nan_to_num(opn[t])) / np.maximum(np.abs(want), 1e-300), opn[t])
            entry = np.where(short, np.where(more & ok, new_entry, entry), np.nan)
        else:
            entry = np.full(m, np.nan)
        end = np.where(ok, close[t], np.nan)
        out_px = exit_px[t] if exit_px is not None else np.full(m, np.nan)
        level = 2 * entry
        dies = ok & short & (high[t] >= level) & (np.isnan(out_px) | (out_px > level) | (out_px < opn[t]))
        out_px = np.where(dies, level, out_px)
        leaves = ok & ~np.isnan(out_px) & (want != 0)
        r = np.where(ok, np.where(leaves, out_px, end) / np.where(ok, opn[t], 1.0) - 1, 0.0)
        gone[t] |= dies & (want != 0)
        cost += float(np.sum(filled * rates[t])) + float(np.sum((np.abs(want * (1 + r)) * rates[t])[leaves]))
        session = float(np.sum(want * r))
        fund = float(np.sum(np.where(leaves, 0.0, want * (1 + r)) * funding[t])) if funding is not None else 0.0
        borrow = float(np.sum(np.abs(want[short]))) * costs.borrow * costs.years
        opened = grow * (1 - cost)
        out["carry"][t] = opened * (fund + borrow) - paid
        out["net"][t] = opened * (1 + session) - 1 - out["carry"][t]
        out["gross"][t] = grow * (1 + session) - 1
        out["cost"][t], out["turnover"][t], out["exposure"][t] = cost, float(np.sum(filled)), float(np.sum(np.abs(want)))
        grew = 1 + session - fund - borrow + paid / opened
        w = np.where(leaves, 0.0, want * (1 + r)) / grew if grew > 1e-12 else np.zeros(m)  # a lost account stays lost
        entry = np.where(leaves, np.nan, entry)
        weights[t] = want
    return Account(**out, weights=weights, liquidated=gone)


@dataclass(frozen=True)
class Exits:
    """Distances as fractions of the entry price, or as multiples of the ATR known when the position was decided."""

    stop: float | None = None
    take: float | None = None
    trail: float | None = None
    stop_atr: float | None = None
    trail_atr: float | None = None
    take_atr: float | None = None


def exits(opn: np.ndarray, high: np.ndarray, low: np.ndarray, side: np.ndarray, rule: Exits, atr: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(exit price or NaN, side held) of one instrument; side is the wanted side decided at each close.

    Stops come before takes; a gap through a level fills at the open; after an exit the instrument stays flat until the
    wanted side changes.
    """
    n = len(opn)
    px, held = np.full(n, np.nan), np.zeros(n)
    now, entry, best, unit, barred = 0.0, np.nan, np.nan, np.nan, 0.0
    for t in range(1, n):
        want = side[t - 1]
        if want != barred:
            barred = 0.0
        if want != now:
            now = 0.0 if barred and want == barred else want
            entry = best = opn[t]
            unit = atr[t - 1] if atr is not None else np.nan
        if now == 0:
            continue
        held[t] = now
        best = max(best, high[t - 1] if t > 1 and held[t - 1] == now else best) if now > 0 else min(best, low[t - 1] if t > 1 and held[t - 1] == now else best)
        stops, takes = [], []
        if rule.stop is not None:
            stops.append(entry * (1 - now * rule.stop))
        if rule.stop_atr is not None and not np.isnan(unit):
            stops.append(entry - now * rule.stop_atr * unit)
        if rule.trail is not None:
            stops.append(best * (1 - now * rule.trail))
        if rule.trail_atr is not None and atr is not None and not np.isnan(atr[t - 1]):
            stops.append(best - now * rule.trail_atr * atr[t - 1])
        if rule.take is not None:
            takes.append(entry * (1 + now * rule.take))
        if rule.take_atr is not None and not np.isnan(unit):
            takes.append(entry + now * rule.take_atr * unit)
        at = np.nan
        if stops:
            level = max(stops) if now > 0 else min(stops)
            if now > 0 and low[t] <= level:
                at = min(opn[t], level)
            elif now < 0 and high[t] >= level:
                at = max(opn[t], level)
        if np.isnan(at) and takes:
            level = min(takes) if now > 0 else max(takes)
            if now > 0 and high[t] >= level:
                at = max(opn[t], level)
            elif now < 0 and low[t] <= level:
                at = min(opn[t], level)
        if not np.isnan(at):
            px[t], barred, now = at, now, 0.0
    return px, held


def hold(opn: np.ndarray, close: np.ndarray, member: np.ndarray, rate: float) -> np.ndarray:
    """Net returns of equal money in all members, dealt anew only when membership changes, at the next open."""
    n, m = close.shape
    known, out, w, had = forward(close), np.zeros(n), np.zeros(m), np.zeros(m, bool)
    for t in range(1, n):
        ok = ~np.isnan(opn[t]) & ~np.isnan(known[t - 1])
        gap = np.where(ok, opn[t] / np.where(ok, known[t - 1], 1.0) - 1, 0.0)
        grow = 1 + float(np.sum(w * gap))
        x, cost = w * (1 + gap) / grow, 0.0
        if (member[t - 1] != had).any():
            had = member[t - 1].copy()
            live = had & ok
            want = np.where(live, 1.0 / max(live.sum(), 1), 0.0)
            cost, x = float(np.abs(want - x).sum()) * rate, want
        r = np.where(ok, close[t] / np.where(ok, opn[t], 1.0) - 1, 0.0)
        session = float(np.sum(x * r))
        out[t] = grow * (1 - cost) * (1 + session) - 1
        w = x * (1 + r) / (1 + session)
    return out


def seats(listed: np.ndarray, side: np.ndarray, liquidity: np.ndarray) -> np.ndarray:
    """Who sits at each bar. As many seats as names are listed; a leaver with an open trade keeps its seat to the trade's
    end; newcomers wait in order of arrival, those of one bar by liquidity, then by column."""
    n, m = listed.shape
    out, sitting, queue = np.zeros((n, m), bool), np.zeros(m, bool), []
    for t in range(n):
        capacity = int(listed[t].sum())
        same = side[t] == (side[t - 1] if t else 0)
        stays = sitting & (listed[t] | ((side[t] != 0) & same))
        queue = [j for j in queue if listed[t, j] and not stays[j]]
        waits = listed[t] & ~stays
        new = [j for j in np.lexsort((np.arange(m), -np.nan_to_num(liquidity[t]))) if waits[j] and j not in queue] if waits.any() else []
        queue += new
        free = capacity - int(stays.sum())
        sitting = stays.copy()
        while free > 0 and queue:
            sitting[queue.pop(0)] = True
            free -= 1
        out[t] = sitting
    return out


def slots(start: np.ndarray, end: np.ndarray, liquidity: np.ndarray, column: np.ndarray, k: int) -> np.ndarray:
    """Which trades are taken with at most k at once; in order of start, liquidity, column. A trade that ends on the bar
    another begins still counts."""
    taken, active = np.zeros(len(start), bool), []
    for i in np.lexsort((column, -liquidity, start)):
        active = [e for e in active if e >= start[i]]
        if len(active) < k:
            active.append(end[i])
            taken[i] = True
    return taken


def buffered_top(rank: np.ndarray, good: np.ndarray, n: int, band: float = 1.5) -> np.ndarray:
    """Members by month: the core (rank up to n / band), then members up to rank n * band, cut to n, filled from the best."""
    months, m = rank.shape
    out, members = np.zeros((months, m), bool), []
    for t in range(months):
        order = [j for j in np.argsort(rank[t], kind="stable") if good[t, j]]
        place = {j: rank[t, j] for j in order}
        core = [j for j in order if place[j] <= n / band]
        keep = [j for j in order if j in members and place[j] <= n * band and j not in core]
        members = (core + keep)[:n]
        members += [j for j in order if j not in members][: n - len(members)]
        out[t, members] = True
    return out


def matrix(pdf: pd.DataFrame, *values: str) -> tuple[pd.Index, pd.Index, list[np.ndarray]]:
    """Long rows as bars x instruments."""
    wide = pdf.pivot(index="ts", columns="instrument", values=list(values)).sort_index()
    names = wide.columns.get_level_values(1).unique().sort_values()
    return wide.index, names, [wide[v].reindex(columns=names).to_numpy(float) for v in values]


def run_account(panel: DataFrame, key: str, costs: Costs, *, book: bool = False) -> DataFrame:
    """Per key and bar the account's figures. panel: key, ts, instrument, open, high, close, target[, exit_px][, quoted]."""
    more = [c for c in ("exit_px", "quoted") if c in panel.columns]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ts, _, x = matrix(pdf, "open", "high", "close", "target", *more)
        a = account(*x[:4], costs, book=np.ones((len(ts), x[0].shape[1]), bool) if book else None, **dict(zip(more, x[4:], strict=True)))
        return pd.DataFrame({key: pdf[key].iloc[0], "ts": ts, "net": a.net, "gross": a.gross, "cost": a.cost, "carry": a.carry, "turnover": a.turnover, "exposure": a.exposure, "unfunded": a.unfunded})

    kind = dict(panel.dtypes)[key]
    return panel.groupBy(key).applyInPandas(run, f"{key} {kind}, ts timestamp, net double, gross double, cost double, carry double, turnover double, exposure double, unfunded double")
