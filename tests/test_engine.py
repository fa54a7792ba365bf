"""Hand-made expectations for the walks, indicators, figures, joins and stores."""

import io
import json
import lzma
import struct
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ravelin.functions import boost
from ravelin.functions import recursion as X
from ravelin.operators import conditioning as C
from ravelin.operators import joins as J
from ravelin.operators import luck as L
from ravelin.operators import metrics as M
from ravelin.operators import panel as P
from ravelin.operators import selection as S
from ravelin.operators import walks as K
from ravelin.plans.strategies import STRATEGIES, _har, until_nth
from ravelin.sources import store
from ravelin.sources import views as V

DAY = datetime(2024, 1, 1)


def col(*x):
    return np.array(x, float)[:, None]


def walk(o, c, target, **more):
    h = more.pop("high", np.fmax(o, c))
    return K.account(o, h, c, target, more.pop("costs", K.Costs(0.0)), **more)


def test_account_of_one_long():
    a = walk(col(10, 10, 11, 12), col(10, 11, 12, 12), col(1, 1, 1, 1))
    assert np.allclose(np.cumprod(1 + a.net), [1, 1.1, 1.2, 1.2])


def test_costs_are_paid_on_what_is_filled():
    a = walk(col(10, 10, 10), col(10, 10, 10), col(1, 0, 0), costs=K.Costs(0.01))
    assert np.allclose(a.net, [0, -0.01, -0.01]) and np.allclose(a.turnover, [0, 1, 1])


def test_units_are_held_without_trades():
    o = np.array([[10, 10], [10, 10], [20, 10], [20, 10]], float)
    a = walk(o, o, np.full((4, 2), 0.5))
    assert np.allclose(a.turnover, [0, 1, 0, 0]) and np.allclose(np.prod(1 + a.net), 1.5)


def test_additions_beyond_the_equity_are_cut():
    o = np.array([[10, 10], [10, 10], [20, 10], [20, 10]], float)
    t = np.array([[0.5, 0], [0.5, 0.5], [0.5, 0.5], [0.5, 0.5]])
    a = walk(o, o, t)
    assert np.isclose(a.unfunded[2], 0.5 - 1 / 3) and a.exposure.max() <= 1 + 1e-12


def test_short_is_liquidated_at_twice_its_entry():
    a = walk(col(10, 10, 10), col(10, 10, 10), col(-1, -1, -1), high=col(10, 10, 25))
    assert np.isclose(a.net[2], -1) and a.liquidated[2, 0]


def test_missed_bars_carry_the_weight():
    n = np.nan
    a = walk(col(10, 10, n, 12), col(10, 10, n, 12), col(1, 1, 1, 1))
    assert np.allclose(np.prod(1 + a.net), 1.2) and a.net[2] == 0


def test_funding_and_dividends():
    a = walk(col(10, 10, 10), col(10, 10, 10), col(1, 1, 1), funding=col(0, 0.01, 0), dividend=col(0, 0, 1))
    assert np.allclose(a.net, [0, -0.01, 0.1 / 0.99])  # the unit is held on a smaller equity


def test_targets_over_the_equity_raise():
    with pytest.raises(ValueError):
        walk(col(1, 1), col(1, 1), col(1.5, 1.5))


def test_exits():
    o, h, lo, side = np.array([10, 10, 9, 8.0]), np.array([10, 11, 9, 8.0]), np.array([10, 9.8, 8.9, 8.0]), np.array([1, 1, 1, 1.0])
    px, held = K.exits(o, h, lo, side, K.Exits(stop=0.05))
    assert px[2] == 9 and held.tolist() == [0, 1, 1, 0]  # a gap through the level fills at the open; flat until the side changes
    px, _ = K.exits(o, h, lo, side, K.Exits(take=0.1))
    assert np.isclose(px[1], 11)
    px, _ = K.exits(o, h, lo, side, K.Exits(stop=0.05, take=0.1, trail=0.05))
    assert np.isclose(px[1], 11) or px[1] <= 10


def test_hold_and_seats_and_slots():
    o = np.array([[10, 10], [10, 10], [20, 10]], float)
    assert np.isclose(np.prod(1 + K.hold(o, o, np.ones((3, 2), bool), 0.0)), 1.5)
    listed = np.array([[1, 0], [0, 1], [0, 1], [0, 1]], bool)
    side = np.array([[1, 1], [1, 1], [0, 1], [0, 1]], float)
    assert K.seats(listed, side, np.ones((4, 2))).tolist() == [[True, False], [True, False], [False, True], [False, True]]
    assert K.slots(np.array([0, 0, 1, 5]), np.array([4, 4, 3, 6]), np.array([1.0, 2, 9, 1]), np.arange(4), 1).tolist() == [False, True, False, True]


def test_buffered_top_keeps_members_in_the_band():
    rank = np.array([[1, 2, 3, 4], [1, 4, 2, 3], [1, 4, 2, 3.0]])
    out = K.buffered_top(rank, np.ones((3, 4), bool), 2, 1.5)
    assert out.tolist() == [[True, True, False, False], [True, False, True, False], [True, False, True, False]]


def test_recursive_indicators():
    x = np.array([1, 2, 3, 4, 5.0])
    assert np.allclose(X.ema_of(x, 3)[2:], [2, 3, 4]) and np.isnan(X.ema_of(x, 3)[:2]).all()
    assert np.allclose(X.rsi_of(np.array([1, 2, 1, 2, 1.0]), 2)[2:], [50, 75, 37.5])
    assert np.allclose(X.rsi_of(np.ones(5), 2)[2:], 0)
    assert np.allclose(X.atr_of(x + 1, x - 1, x, 2)[2:], 2)
    up = np.arange(40.0)
    assert np.allclose(X.adx_of(up + 1, up - 1, up, 5)[9:], 100) and np.isnan(X.adx_of(up + 1, up - 1, up, 5)[8])


def test_rules_with_memory():
    held = lambda entry, below: until_nth("e", "b", 2, "x")(pd.DataFrame({"e": entry, "b": below}, dtype=bool))["x"].tolist()
    assert held([1, 0, 0, 0, 0], [0, 1, 0, 1, 0]) == [1, 1, 1, 0, 0]
    assert held([1, 0, 1, 1, 0], [1, 1, 0, 1, 0]) == [1, 1, 1, 1, 1]  # signs on the entry's bar don't count; in again on the bar it is out
    assert held([0, 0, 0], [1, 1, 1]) == [0, 0, 0]


def test_har_is_least_squares_on_the_past():
    rng = np.random.default_rng(0)
    close, horizon = np.exp(np.cumsum(rng.normal(size=700) * 0.02)), 10
    got = _har(horizon)(pd.DataFrame({"close": close}))["har"] / 365
    r2 = pd.Series(np.r_[np.nan, np.diff(np.log(close))] ** 2)
    x = np.column_stack([np.ones(700), *(r2.rolling(w).mean() for w in (1, 5, 22))])
    y = np.array([r2[i + 1 : i + 1 + horizon].mean() if i + horizon < 700 else np.nan for i in range(700)])
    for refit in (250, 341, 523):
        learn = [i for i in range(refit - horizon + 1) if np.isfinite(x[i]).all() and np.isfinite(y[i])]
        want = np.maximum(x[refit] @ np.linalg.lstsq(x[learn], y[learn], rcond=None)[0], 1e-10)
        assert np.isclose(got[refit], want, rtol=1e-6)
    assert np.isnan(got[:250]).all()


def test_boosting_finds_an_edge_and_none():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = (x[:, 2] + 0.5 * rng.normal(size=2000) > 0).astype(float)
    at = np.arange(2000.0)
    p = boost.expanding(x, y, at, at + 1, np.arange(500.0, 2000, 250))
    assert np.isnan(p[:500]).all() and ((p[500:] > 0.5) == y[500:]).mean() > 0.8
    q = boost.expanding(x, rng.integers(0, 2, 2000).astype(float), at, at + 1, np.arange(500.0, 2000, 250))
    assert abs((q[500:] > 0.5).mean() - 0.5) < 0.3


def record(spark, *r, key="k"):
    return spark.createDataFrame([(key, DAY + timedelta(days=i), float(x)) for i, x in enumerate(r)], "key string, day timestamp, r double")


def test_drawdown_and_ratios(spark):
    c = M.core(record(spark, 0.1, -0.2, 0.125, 0.2)).first()
    assert np.isclose(c.max_dd, -0.2) and c.underwater == 2 and np.isclose(c.growth, 1.188)
    assert np.isclose(M.core(record(spark, 0.02, 0.02, -0.02, -0.02)).first().sharpe, 0)
    assert np.isclose(M.core(record(spark, 0.01, -0.01)).first().sortino, 0)


def test_days_and_months(spark):
    hours = spark.createDataFrame([("k", DAY + timedelta(hours=h), 0.1) for h in (12, 24, 25, 73)], "key string, ts timestamp, r double")
    d = {r.day: r.r for r in M.daily(hours, "ts", "r").collect()}
    assert len(d) == 4 and np.isclose(d[DAY], 0.21) and d[DAY + timedelta(days=2)] == 0
    assert [r.month.month for r in M.monthly(record(spark, *[0.01] * 80)).orderBy("month").collect()] == [1, 2]


def test_look_ahead_is_not_in_the_strategies(spark, sf):
    """Positions don't change when later bars are taken away."""
    bars = V.bars_region(spark, sf).cache()
    cut = datetime(1999, 1, 1)
    early = bars.where(F.col("ts") < F.lit(cut))
    for name in ("sma_cross", "rsi2_connors", "calm_trend", "market_regime", "pocket_pivot", "regime_ema_trail", "vol_managed_har", "ml_direction", "gtaa_faber"):
        s = STRATEGIES[name]
        a = s.positions(bars).where(F.col("ts") < F.lit(cut)).toPandas().sort_values(["instrument", "ts"])
        b = s.positions(early).toPandas().sort_values(["instrument", "ts"])
        assert np.allclose(a.position, b.position), name


def test_grid_leaves_out_more_picks_than_names():
    assert {c["top_k"] for c in STRATEGIES["dual_momentum"].configs(4)} == {1, 2, 3, 4}


def test_as_of_and_next_bar(spark):
    t = lambda h: DAY + timedelta(hours=h)
    left = spark.createDataFrame([("a", t(h)) for h in (1, 2, 5)] + [("b", t(9))], "k string, ts timestamp")
    right = spark.createDataFrame([("a", t(2), 7.0), ("a", t(4), None)], "k string, at timestamp, v double")
    got = [(r.ts.hour, r.v, r.value_ts) for r in J.as_of(left, right, "k", "ts", "at", ["v"]).where("k = 'a'").orderBy("ts").collect()]
    assert got == [(1, None, None), (2, 7.0, t(2)), (5, None, t(4))]
    strict = J.as_of(left, right, "k", "ts", "at", ["v"], strict=True).where("k = 'a'").orderBy("ts").collect()
    assert [r.v for r in strict] == [None, None, None]
    nxt = J.next_bar(right, left.withColumnRenamed("k", "k"), "k", "at", ["v"]).orderBy("at").collect()
    assert [r.bar_ts for r in nxt] == [t(2), t(5)]


def test_walk_forward_prefers_the_better_and_the_first(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 0.01, 600)
    rows = [(k, DAY + timedelta(days=i), float(base[i] + (0.002 if k == 1 else 0))) for k in (0, 1, 2) for i in range(600)]
    rec = spark.createDataFrame(rows, "config int, day timestamp, r double")
    fold = S.folds(rec)
    assert fold.count() == 3 and {r.config for r in S.choose(rec, fold).collect()} == {1}
    same = rec.where("config <> 1")
    assert {r.config for r in S.choose(same, fold).collect()} == {0}
    assert S.overfitting_share(rec, 6).first().pbo == 0


def test_bootstrap_and_luck(spark):
    rng = np.random.default_rng(0)
    ar = np.convolve(rng.normal(size=3000), np.ones(10), "valid")
    assert L.block_length(rng.normal(size=3000)) < L.block_length(ar)
    at = L.stationary(1000, 20, rng)
    assert 0.9 < np.mean(np.diff(at) % 1000 == 1) < 0.98
    assert np.isclose(L.expected_max(2), 1 / np.sqrt(np.pi), atol=1e-4)
    up = record(spark, *(0.001 + rng.normal(0, 0.01, 400)))
    a, b = (L.monte_carlo(up, 40, 20).orderBy("figure").collect() for _ in range(2))
    assert a == b and all(r.p5 <= r.p50 <= r.p95 for r in a if not r.figure.endswith('missed')) and len(a) == 7
    k = L.at_target_drawdown(record(spark, 0.1, -0.05, 0.1)).first()
    assert np.isclose(k.multiple, 2, atol=1e-6)


def test_stale_runs_are_replaced(spark):
    px = [10, 11, 11, 11, 11, 12]
    bar = lambda c: (float(c),) * 4
    b = spark.createDataFrame([("a", DAY + timedelta(days=i), *bar(c)) for i, c in enumerate(px)], "instrument string, ts timestamp, open double, high double, low double, close double")
    o = spark.createDataFrame([("a", DAY + timedelta(days=i), *bar(c / 2)) for i, c in enumerate([10, 11, 12, 13, 14, 15])], b.schema)
    got = C.stale_replaced(b, o).orderBy("ts").collect()
    assert [r.close for r in got] == [10, 11, 12, 13, 14, 12] and [r.replaced for r in got] == [False, False, True, True, True, False]


def test_clean_reasons_have_precedence(spark):
    rows = [("a", DAY, None, 1.0, 1.0, 1.0, 1), ("a", DAY, -1.0, 1.0, 1.0, 1.0, 2), ("a", DAY, 2.0, 1.0, 1.0, 1.0, 3), ("a", DAY, 1.0, 1.0, 1.0, 1.0, 4), ("a", DAY, 1.0, 1.0, 1.0, 1.0, 5)]
    b = spark.createDataFrame(rows, "instrument string, ts timestamp, open double, high double, low double, close double, n int")
    assert [r.reason for r in P.clean(b, "n").orderBy("n").collect()] == ["null_price", "not_positive", "high_low", "duplicate", None]


def test_store_round_trip_prunes_and_refuses(spark, sf, tmp_path):
    bars = V.bars_region(spark, sf)
    root = str(tmp_path / "bars")
    store.write_bars(bars, root, "1d")
    back = store.read_bars(spark, root, "1d", ["ASIA"], start="1996-01-01", columns=["close"])
    plan = back._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "instrument" in plan.split("PartitionFilters")[1][:200] and "PushedFilters" in plan
    assert back.count() == bars.where("instrument = 'ASIA' AND ts >= '1996-01-01'").count()
    with pytest.raises(ValueError):
        store.write_bars(bars.union(bars), root, "1d")
    rec = record(spark, 0.1, 0.2, 0.3)
    assert store.decode_series(store.encode_series(rec)).collect() == rec.select("key", "day", "r").collect()
    with pytest.raises(Exception, match="gap"):
        store.encode_series(rec.where("r <> 0.2")).collect()


def test_vendor_files(spark, tmp_path):
    row = [1704067200000, "1", "3", "0.5", "2", "10", 1704070799999, "20", 5]
    k = store.klines(spark.createDataFrame([("a", json.dumps(row))], "instrument string, json string")).first()
    assert (k.ts, k.open, k.close, k.dollar_volume) == (datetime(2024, 1, 1, 1), 1, 2, 20)
    (tmp_path / "a.csv").write_text("open_time,open\n1704067200000,1,3,0.5,2,10,1704070799999,20\n1735689600000000,1,3,0.5,2,10,1735693199999999,20\n")
    assert [r.ts for r in store.archive_csv(spark, str(tmp_path / "a.csv"), "a").orderBy("ts").collect()] == [datetime(2024, 1, 1, 1), datetime(2025, 1, 1, 1)]
    (tmp_path / "z.csv").write_text("T,20240701,000100,1,2,0.5,1.5\n")
    assert store.zoned_csv(spark, str(tmp_path / "z.csv")).first().ts == datetime(2024, 6, 30, 22, 1)
    body = io.BytesIO(b"".join(struct.pack(">IIIIIf", s, 100000, 110000, 90000, 120000, 1.5) for s in (0, 3600)))
    files = spark.createDataFrame([("p", DAY, bytearray(lzma.compress(body.read())))], "path string, start timestamp, content binary")
    c = store.packed_candles(files).orderBy("ts").collect()
    assert [r.ts for r in c] == [DAY, DAY + timedelta(hours=1)] and (c[0].open, c[0].close, c[0].low, c[0].high) == (1.0, 1.1, 0.9, 1.2)


def test_streams_equal_batches(spark, sf):
    """Windows of the stream, those open at its end too, are those of a batch over the same events."""
    from ravelin.streaming import bars as T

    got = T.whole(spark, sf, T.hourly_bars).select("instrument", "ts", "open", "high", "low", "close", "volume")
    want = V.bars_event(spark, sf).select(*got.columns)
    assert got.count() > 0 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_luck_queries_have_the_operators_own_sizes(spark, sf, monkeypatch):
    from ravelin.operators import luck
    from ravelin.plans import engine_queries

    for fn, query in (("monte_carlo", "monte_carlo"), ("random_timing", "random_timing"), ("paired", "paired_t")):
        given = []
        monkeypatch.setattr(luck, fn, lambda record, *a, **k: given.append((a, k)) or record)
        getattr(engine_queries, query)(spark, sf)
        assert given == [((), {})]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_exact_sums_in_any_partitioning(spark, parts):
    from math import fsum

    from ravelin.operators.sums import exact_sum

    rng = np.random.default_rng(3)
    wide = [float(x) for x in rng.normal(size=400) * 10.0 ** rng.integers(-12, 18, 400)]
    groups = {"cancel": [1e16, 1.0, -1e16], "tiny": [1e-300, 1.0, -1.0, 5e-324], "wide": wide, "back": [*wide, *(-x for x in reversed(wide)), 0.125], "none": [None], "zero": [0.0, -0.0], "huge": [1e300, -1e300, 2.5], "cents": [0.1] * 1000}
    rows = [(k, x) for k, v in groups.items() for x in v]
    df = spark.createDataFrame(rows, "k string, x double").repartition(parts)
    got = {r.k: r.total for r in exact_sum(df, ["k"], "x").collect()}
    want = {k: fsum(x for x in v if x is not None) for k, v in groups.items() if k != "none"}
    assert set(got) == set(want) and got["cancel"] == 1.0 and got["back"] == 0.125
    assert all(abs(got[k] - want[k]) <= abs(want[k]) * 2.3e-16 for k in want), {k: (got[k], want[k]) for k in want}
    odd = spark.createDataFrame([("n", float("nan")), ("n", 1.0), ("i", float("inf")), ("i", 1.0)], df.schema)
    x = {r.k: r.total for r in exact_sum(odd, ["k"], "x").collect()}
    assert np.isnan(x["n"]) and x["i"] == float("inf")
