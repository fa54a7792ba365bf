"""From what a strategy wants to an account: membership, exits, seats, slots, shares and the walk, one book per group.

A book couples all names of a list at every bar, so it is one ordered pass; configurations are groups and run in parallel.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.functions.recursion import atr_of
from ravelin.operators.walks import Account, Costs, Exits, account, exits, forward, hold, matrix, seats, slots

EXIT_KEYS = ("stop", "take", "trail", "stop_atr", "trail_atr", "take_atr")
ATR, SEASON = 14, 90  # bars of the ATR that exits are measured in, and of the liquidity that seats and slots are given by
_VALUES = ("open", "high", "low", "close", "position", "listed", "money", "funding", "dividend", "quoted")


def cut_by_exits(x: dict[str, np.ndarray], wanted: np.ndarray, rule: Exits) -> tuple[np.ndarray, np.ndarray]:
    """What is wanted, flat from an exit until the side changes, and the exits' prices. Names are walked on their own bars."""
    out, px = wanted.copy(), np.full(wanted.shape, np.nan)
    inside = "held" in x  # exits walked through minutes before: held sides and prices come with the bars
    for k in range(wanted.shape[1]):
        at = np.flatnonzero(~np.isnan(x["close"][:, k]))
        if len(at) < 2:
            continue
        o, h, lo, c = (x[f][at, k] for f in ("open", "high", "low", "close"))
        if inside:
            left, held = x["exit_px"][at, k], np.nan_to_num(x["held"][at, k])
        else:
            left, held = exits(o, h, lo, np.sign(wanted[at, k]), rule, atr_of(h, lo, c, ATR))
        px[at, k] = left
        now = np.r_[held[1:], 0.0 if not np.isnan(left[-1]) else np.sign(wanted[at[-1], k])]  # what is held after each decision
        keep = np.full(len(wanted), np.nan)
        keep[at] = now == np.sign(wanted[at, k])
        out[:, k] *= np.nan_to_num(forward(keep[:, None], 1.0)[:, 0])
    return out, px


def spans_of(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first, last) of every run of one side."""
    side = np.sign(w)
    new = (side != 0) & (side != np.vstack([np.zeros((1, w.shape[1])), side[:-1]]))
    end = (side != 0) & (side != np.vstack([side[1:], np.zeros((1, w.shape[1]))]))
    (k, first), (_, last) = np.nonzero(new.T), np.nonzero(end.T)
    return k, first, last


def with_slots(raw: np.ndarray, money: np.ndarray, n: int) -> np.ndarray:
    """At most n trades at once, each a share of 1 / n; a trade that finds none free is never taken."""
    k, first, last = spans_of(raw)
    taken = slots(first, last, np.nan_to_num(money[first, k], nan=-np.inf), k, n)
    out = np.zeros_like(raw)
    for name, a, z in zip(k[taken], first[taken], last[taken], strict=True):
        out[a : z + 1, name] = raw[a : z + 1, name] / n
    return out


def rule_of(params: dict[str, Any]) -> Exits:
    return Exits(**{k: params[k] for k in EXIT_KEYS if params.get(k) is not None})


def target_of(x: dict[str, np.ndarray], kind: str, params: dict[str, Any]) -> tuple[np.ndarray, np.ndarray | None]:
    """The weights decided at each close, and prices of exits within bars. x: arrays of bars x names.

    A rule's names share the equity alike among the seats taken, or among slots; a panel gives weights itself, and so do
    units (a panel whose positions are held each by itself, with exits of their own). A name trades from its first bar to
    its last and while it is listed (a rule's trade is kept to its end).
    """
    printed = ~np.isnan(x["close"])
    last = len(printed) - 1 - printed[::-1].argmax(axis=0)
    live = (np.cumsum(printed, axis=0) > 0) & (np.arange(len(printed))[:, None] <= last)
    listed = live & (np.nan_to_num(forward(x["listed"], 1.0)) > 0)
    wanted = np.where(live, np.clip(np.nan_to_num(forward(x["position"], 0.0)), -1, 1), 0.0)
    rule, px = rule_of(params), None
    if kind == "units" and rule != Exits():
        wanted, px = cut_by_exits(x, wanted, rule)
    if kind in ("panel", "units"):
        weights = np.where(listed, wanted, 0.0)
        return weights / np.maximum(np.abs(weights).sum(axis=1, keepdims=True), 1.0), px
    if rule != Exits():
        wanted, px = cut_by_exits(x, wanted, rule)
    seated = listed if kind == "exposure" else seats(listed, np.sign(wanted), x["money"])
    raw = np.where(seated, wanted, 0.0)
    if params.get("slots"):
        return with_slots(raw, x["money"], params["slots"]), px
    return raw / np.maximum(seated.sum(axis=1, keepdims=True), 1), px


def walked(pdf: pd.DataFrame, kind: str, params: dict[str, Any], costs: Costs, delay: int = 0) -> tuple[pd.Index, pd.Index, dict[str, np.ndarray], Account]:
    inside = [c for c in ("exit_px", "held") if c in pdf.columns]
    ts, names, arrays = matrix(pdf, *_VALUES, *inside)
    x = dict(zip((*_VALUES, *inside), arrays, strict=True))
    if delay:  # a decision comes later, and its exits are walked from the later fill, on bars
        x = {k: v for k, v in x.items() if k not in inside}
        x["position"] = np.vstack([np.zeros((delay, len(names))), forward(x["position"], 0.0)[:-delay]])[: len(ts)]
    target, px = target_of(x, kind, params)
    book = np.ones(target.shape, bool) if kind == "panel" else None
    more = {n: np.nan_to_num(x[n]) if np.nansum(np.abs(x[n])) else None for n in ("funding", "dividend")}
    quoted = x["quoted"] if (~np.isnan(x["quoted"])).any() else None
    return ts, names, x, account(x["open"], x["high"], x["close"], target, costs, book=book, exit_px=px, quoted=quoted, **more)


def wanted_books(
    bars: DataFrame, positions: DataFrame, configs: DataFrame, member: DataFrame | None = None, carry: DataFrame | None = None, quotes: DataFrame | None = None,
    inside: DataFrame | None = None, names: DataFrame | None = None,
) -> DataFrame:
    """The rows of every configuration's book. positions: signal, instrument, ts, position; configs: config, signal[, variant].

    member: instrument, ts, listed; carry: instrument, ts, funding, dividend; quotes: instrument, ts, rate. Without them all
    names are listed, pay nothing and cost the flat rate. inside: instrument, ts, variant, exit_px, held, from minutes.
    names: the instruments that a book may hold; others don't come into it, but their days do.
    """
    from ravelin.operators.states import liquidity

    of = bars if names is None else bars.join(names, "instrument", "left_semi")
    base = liquidity(of, SEASON).select("instrument", "ts", "open", "high", "low", "close", F.col("liquidity").alias("money"))
    given = [(member, {"listed": "listed"}), (carry, {"funding": "funding", "dividend": "dividend"}), (quotes, {"rate": "quoted"})]
    for table, names in given:
        if table is None:
            base = base.withColumns({c: F.lit(None).cast("double") for c in names.values()})
        else:
            base = base.join(table.select("instrument", "ts", *(F.col(c).cast("double").alias(to) for c, to in names.items())), ["instrument", "ts"], "left")
    books = base.join(positions, ["instrument", "ts"]).join(F.broadcast(configs), "signal").drop("signal")  # a grid: as many rows as configurations
    if inside is not None:
        books = books.join(inside.select("instrument", "ts", "variant", "exit_px", "held"), ["instrument", "ts", "variant"], "left")
    if names is not None:
        days = other_days(bars).join(F.broadcast(configs.select("config")))  # the calendar, for each configuration
        books = books.unionByName(days, allowMissingColumns=True)
    return books.drop("variant")


def ever_listed(bars: DataFrame, member: DataFrame) -> DataFrame:
    """(instrument): names that are listed on any of their bars, or of which a bar has no membership."""
    on = bars.select("instrument", "ts").join(member.select("instrument", "ts", F.col("listed").cast("double").alias("listed")), ["instrument", "ts"], "left")
    return on.groupBy("instrument").agg(F.max(F.coalesce("listed", F.lit(1.0))).alias("most")).where("most > 0").select("instrument")


def held_by(bars: DataFrame, member: DataFrame) -> DataFrame:
    """(instrument): names that a list's book may hold, and the first of all, which carries the calendar."""
    return ever_listed(bars, member).union(bars.agg(F.min("instrument"))).distinct()


def other_days(bars: DataFrame) -> DataFrame:
    """(instrument, ts): days without a bar of the first name of all, under that name. With a name's own bars they make the whole calendar."""
    first = bars.agg(F.min("instrument").alias("instrument"))  # one row
    days = bars.groupBy("ts").agg(F.min("instrument").alias("_least"))
    return days.join(F.broadcast(first)).where("_least <> instrument").select("instrument", "ts")


def bought_and_held(bars: DataFrame, rate: float, since: Any, member: DataFrame | None = None) -> DataFrame:
    """(ts, net) of equal money in the list's members from a moment on: the account that a strategy is measured against."""
    base = bars.select("instrument", "ts", "open", "close")
    if member is None:
        base = base.withColumn("listed", F.lit(1.0))
    else:
        named = base.join(held_by(bars, member), "instrument", "left_semi").join(member.select("instrument", "ts", F.col("listed").cast("double").alias("listed")), ["instrument", "ts"], "left")
        base = named.unionByName(other_days(bars), allowMissingColumns=True)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ts, _, (o, c, listed) = matrix(pdf, "open", "close", "listed")
        printed = ~np.isnan(c)
        last = len(printed) - 1 - printed[::-1].argmax(axis=0)
        live = (np.cumsum(printed, axis=0) > 0) & (np.arange(len(printed))[:, None] < np.where(last == len(printed) - 1, len(printed), last)[None, :])
        return pd.DataFrame({"ts": ts, "net": hold(o, c, live & (forward(listed, 0.0) > 0) & np.asarray(ts >= since)[:, None], rate)})

    return base.groupBy(F.lit("list").alias("book")).applyInPandas(lambda pdf: one(pdf), "ts timestamp, net double")  # a list's account couples its names


def run_books(books: DataFrame, kind: str, params: list[dict[str, Any]] | dict[int, dict[str, Any]], costs: Costs, delay: int = 0) -> DataFrame:
    """(config, ts, net, gross, cost, carry, turnover, exposure, unfunded) of each configuration's account."""
    names = ("net", "gross", "cost", "carry", "turnover", "exposure", "unfunded")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ts, _, _, a = walked(pdf, kind, params[int(pdf["config"].iloc[0])], costs, delay)
        return pd.DataFrame({"config": pdf["config"].iloc[0], "ts": ts} | {n: getattr(a, n) for n in names})

    spread = books.repartition(4 * books.sparkSession.sparkContext.defaultParallelism, "config")  # little data, much work: not to be coalesced
    return spread.groupBy("config").applyInPandas(one, "config int, ts timestamp, " + ", ".join(f"{n} double" for n in names))


def held_weights(books: DataFrame, kind: str, params: list[dict[str, Any]], costs: Costs) -> DataFrame:
    """(config, instrument, ts, weight, gap, session, funding, member): what was held over each bar, for the valuation of timing."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ts, names, x, a = walked(pdf, kind, params[int(pdf["config"].iloc[0])], costs)
        known = np.vstack([np.full((1, len(names)), np.nan), forward(x["close"])[:-1]])
        flat = lambda v: v.T.ravel()
        return pd.DataFrame({
            "config": pdf["config"].iloc[0], "instrument": np.repeat(names.to_numpy(), len(ts)), "ts": np.tile(ts.to_numpy(), len(names)), "weight": flat(a.weights),
            "gap": flat(x["open"] / known - 1), "session": flat(x["close"] / x["open"] - 1), "funding": flat(np.nan_to_num(x["funding"])), "member": flat((np.nan_to_num(forward(x["listed"], 1.0)) > 0).astype(float)),
        })

    return books.groupBy("config").applyInPandas(one, "config int, instrument string, ts timestamp, weight double, gap double, session double, funding double, member double")
