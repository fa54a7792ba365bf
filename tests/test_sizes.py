"""What larger tables and odd moments showed: equal averages, seconds at the edge of a span, lists of many names, models of whole grids."""

from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ravelin.functions import indicators as I
from ravelin.operators.intrabar import exits_inside
from ravelin.operators.joins import as_of
from ravelin.operators.walks import Costs, Exits
from ravelin.plans import evaluate_queries, robust
from ravelin.plans.catalog import ORACLE, QUERIES
from ravelin.plans.evaluate import Evaluation, books_of, records_of, stitch
from ravelin.plans.strategies import STRATEGIES

DAY = datetime(2024, 1, 1)


def test_averages_that_differ_by_rounding_give_no_side(spark):
    close = [57.55, 15.49, 41.43, 42.63, 42.43, 62.09, 35.43, 19.11, 4.08, 23.74, 32.0, 71.76, 42.34, 199.8, 13.38, 38.51, 1.61, 110.59, 77.46, 6.25]  # both means are 46.884
    b = spark.createDataFrame([("a", DAY + timedelta(hours=i), c, c / 8) for i, c in enumerate([*close, 99.0, 1.0])], "instrument string, ts timestamp, close double, low double")
    fast, slow = I.sma("close", 5), I.sma("close", 20)
    got = [r.side for r in b.withColumn("side", I.cross(fast, slow)).orderBy("ts").collect()]
    assert got[:19] == [None] * 19 and got[19] == 0 and got[20] == 1
    assert b.withColumn("side", I.cross(I.sma("low", 5), I.sma("low", 20))).orderBy("ts").collect()[19].side == 0


def test_change_log_is_cut_at_the_nearest_second(spark):
    """The newest is at .7 of a second; a day before it .3 and .5 are of an even second, .5 and .6 of the next."""
    from ravelin.streaming.upkeep import recent_changes

    micros = [0, 300_000, 500_000, 700_000, 999_999, 1_000_000, 1_300_000, 1_500_000, 1_700_000, 2_500_000]
    rows = [(i, DAY + timedelta(microseconds=m), "a") for i, m in enumerate([*micros, 86_400_700_000])]
    events = pd.DataFrame(rows, columns=["event_id", "ts", "event_type"])  # noqa: F841
    got = recent_changes(spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string"))
    (want,) = duckdb.query(ORACLE["change_log_kept"]).fetchall()
    ids = sorted(r.event_id for r in got.collect())
    assert (len(ids), ids[0]) == want[1:]


def test_members_are_streamed_and_lists_kept_apart(spark, sf):
    """No list's events meet in one pandas group, and lists that share a task, over batches of few rows, give what SQL gives."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        out = QUERIES["list_members"](spark, sf)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        got = sorted((r.list, r.instrument, r.start, r.end is None, r.end) for r in out.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    duck = duckdb.connect()
    for t in ("lineitem", "supplier", "nation", "region"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = sorted((a, b, s, e is None, e) for a, b, s, e in duck.execute(ORACLE["list_members"]).fetchall())
    assert "FlatMapGroupsInPandas" not in plan and got == want and len(want) > 5


def test_names_that_are_never_listed_leave_the_books_but_not_the_calendar(spark):
    from ravelin.operators import books as B
    from ravelin.operators.walks import Costs
    from ravelin.plans.evaluate import books_of
    from ravelin.plans.strategies import STRATEGIES

    days = [DAY + timedelta(days=i) for i in range(12)]
    prints = {"a": range(0, 12, 3), "b": [i for i in range(12) if i != 5], "c": range(12), "d": range(12)}  # a and d are never listed; b alone is from day 3 on
    rows = [(n, days[i], 10.0 + i, 11.0 + i, 9.0 + i, 10.0 + (i * 7 % 5), 1.0, 10.0) for n, at in prints.items() for i in at]
    bars = spark.createDataFrame(rows, "instrument string, ts timestamp, open double, high double, low double, close double, volume double, dollar_volume double")
    member = bars.select("instrument", "ts", ((F.col("instrument") == "b") & (F.col("ts") >= days[3])).alias("listed"))
    s = STRATEGIES["ibs"]
    configs = s.configs()[:2]
    books = books_of(bars, s, configs, member)
    assert {r.instrument for r in books.where("close IS NOT NULL").select("instrument").distinct().collect()} == {"a", "b"}  # a, the first of all, carries the calendar
    got = B.run_books(books, s.kind, configs, Costs())
    whole = B.wanted_books(bars, s.positions(bars).withColumn("signal", F.lit(0)), spark.createDataFrame([(0, 0), (1, 0)], "config int, signal int"), member)
    as_rows = lambda d: [(r.config, r.ts, round(r.net, 12)) for r in d.orderBy("config", "ts").collect()]
    assert as_rows(got) == as_rows(B.run_books(whole, s.kind, configs, Costs())) and got.count() == 24


def test_runs_share_states(spark, tmp_path):
    """Beats of many runs in two batches: pauses within and across batches, and runs that end, whatever the number of shares."""
    from ravelin.streaming import bars as S
    from ravelin.streaming import upkeep as U

    at = lambda m: DAY + timedelta(seconds=m)
    one = [(f"r{i}", at(s)) for i in range(30) for s in (0, 120, 241 + i)]  # 120 s are no silence
    two = [(f"r{i}", at(3000)) for i in range(10)] + [("end", at(90_000))]
    for rows in (one, two):
        spark.createDataFrame(rows, "run string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = []
    for shares in (1, 3):
        stream = spark.readStream.schema("run string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("ts", "2 hours")
        got.append(sorted((r.run, r.last_beat, r.interrupted) for r in S.drained(U.silent(stream, shares)).collect()))
    want = [(f"r{i}", at(120), False) for i in range(30)] + [(f"r{i}", at(241 + i), i >= 10) for i in range(30)] + [(f"r{i}", at(3000), True) for i in range(10)]
    assert got == [sorted(want)] * 2


def dips(spark, names=5, n=700):
    """Bars of names whose closes lie anywhere in their ranges and rise, more often than not, after low ones."""
    rng, rows = np.random.default_rng(3), []
    for k in range(names):
        c, low = 100.0, False
        for t in range(n):
            c *= float(np.exp(rng.normal(0.006 if low else -0.001, 0.01)))
            up, down = rng.uniform(0.001, 0.02, 2).tolist()
            low = down < 0.25 * (up + down)
            rows.append((f"n{k}", DAY + timedelta(days=t), c * (1 + (up - down) / 2), c * (1 + up), c * (1 - down), c, float(rng.uniform(50, 150)), 100 * c))
    return spark.createDataFrame(rows, "instrument string, ts timestamp, open double, high double, low double, close double, volume double, dollar_volume double")


def test_a_grid_of_a_model_is_made_once_per_rule_and_seed(spark):
    """Whatever the number of thresholds and slots, a grid's books read the models' chances; positions are those of each set alone."""
    s, bars = STRATEGIES["ibs_ml_filter"], dips(spark).localCheckpoint()
    grid = [c for c in s.configs(4) if c["buy_below"] != 0.15 and c["sell_above"] == 0.75]
    assert "Pandas" not in books_of(bars, s, grid)._jdf.queryExecution().toString()
    sets = [{"buy_below": b, "sell_above": 0.75, "threshold": t, "seed": seed} for b, t, seed in ((0.25, 0.5, 7), (0.25, 0.6, 7), (0.2, 0.5, 7), (0.25, 0.5, 1))]
    together = s.positions_of(bars, sets).toPandas().set_index(["signal", "instrument", "ts"]).position.sort_index()
    assert together.groupby("signal").sum().nunique() > 2
    for i, p in enumerate(sets):
        alone = s.positions(bars, **p).toPandas().set_index(["instrument", "ts"]).position.sort_index()
        assert (together[i].to_numpy() == alone.to_numpy()).all() and list(together[i].index) == list(alone.index)


def test_other_seeds_of_chosen_configurations_are_stitched_as_one_alone(spark):
    s, bars, costs = STRATEGIES["ibs_ml_filter"], dips(spark).localCheckpoint(), Costs(0.0005, 0.005)
    configs = [c for c in s.configs(4) if c["buy_below"] == 0.25 and c["sell_above"] == 0.75 and c["slots"] is None][:3]
    record = records_of(bars, s, configs, costs).localCheckpoint()
    folds = robust.S.folds(record).localCheckpoint()
    chosen = folds.select("fold", (F.col("fold") % 2 * 2).cast("int").alias("config"))
    e = Evaluation(s, configs, bars, bars, record, folds, chosen, record, record, record, costs, {"bars": bars, "length": "1 day"})
    n, own = 3, {i: configs[i] for i in (0, 2)}
    seeded = robust.replayed(e, s, {k * n + i: c | {"seed": seed} for k, seed in enumerate((1, 2)) for i, c in own.items()})
    keyed = seeded.select(F.floor(F.col("config") / n).cast("string").alias("key"), (F.col("config") % n).alias("config"), "day", "r")
    got = {(r.key, r.day): r.r for r in robust.S.stitched(keyed, folds, chosen, costs.rate, ["key"]).collect()}
    for k, seed in enumerate((1, 2)):
        want = {(str(k), r.day): r.r for r in stitch(e, records_of(bars, s, [c | {"seed": seed} for c in configs], costs)).collect()}
        assert {x: v for x, v in got.items() if x[0] == str(k)} == want and any(want.values())


def test_robustness_of_a_model_takes_the_whole_grid(spark, sf, monkeypatch):
    asked = []

    def evaluated(bars, strategy, configs=None, **more):
        asked.append(configs or strategy.configs(5))
        raise InterruptedError

    monkeypatch.setattr(evaluate_queries, "evaluate", evaluated)
    with pytest.raises(InterruptedError):
        evaluate_queries.robustness_model(spark, sf)
    assert asked[0] == STRATEGIES["ibs_ml_filter"].configs(5) and len(asked[0]) == 90


def test_rows_of_a_key_meet_where_partitions_are_coalesced_by_their_sizes(spark):
    """Both sides of a union come dealt by the key, the one much larger: each bar still meets its minutes, each question its answer."""
    small = {"spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.unionOutputPartitioning": "true"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        w = Window.partitionBy("instrument").orderBy("ts")
        name = F.concat(F.lit("n"), (F.col("id") % 9).cast("string")).alias("instrument")
        stamp = lambda step: F.timestamp_seconds(F.unix_seconds(F.lit(DAY)) + (F.floor(F.col("id") / 9) + 1) * step).alias("ts")
        bars = spark.range(9 * 50).select(name, stamp(3600), F.lit(100.0).alias("open"), F.lit(101.0).alias("high"), F.lit(99.0).alias("low"), F.lit(1.0).alias("atr"))
        bars = bars.withColumn("nth", F.row_number().over(w)).withColumn("sides", F.array(F.when(F.col("nth") % 5 == 0, 0.0).otherwise(1.0)))
        minutes = spark.range(9 * 50 * 60).select(name, stamp(60), F.lit(100.0).alias("open"), F.lit(101.0).alias("high"), F.lit(99.0).alias("low"))
        minutes = minutes.withColumn("nth", F.row_number().over(w))
        rows = exits_inside(bars, minutes, [Exits(stop=0.005)], ["bar"]).where("exit_px IS NOT NULL").collect()
        assert len(rows) == 9 * 10 and all(r.exit_at == r.ts - timedelta(hours=1) for r in rows)
        spark.conf.set("spark.sql.unionOutputPartitioning", "true")
        found = as_of(minutes.select("instrument", "ts", "nth"), bars.select("instrument", F.col("ts").alias("at"), F.col("nth").alias("hour")), "instrument", "ts", "at", ["hour"])
        assert found.where("hour IS NOT DISTINCT FROM nullif(floor(nth / 60), 0)").count() == 9 * 50 * 60
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
