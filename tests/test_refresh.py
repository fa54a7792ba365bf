"""A store that grows by commits, and plans against saved sides: what is run again changes nothing."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ravelin.sources.store import read_bars
from ravelin.streaming import refresh as R

BAR = "instrument string, ts timestamp, open double, high double, low double, close double, volume double"


def bars(spark, *rows):
    return spark.createDataFrame([(n, datetime(2024, 1, 1, h), c, c, c, c, 1.0) for n, h, c in rows], BAR)


def stored(spark, root):
    got = R.read_committed(spark, root, "1h")
    return sorted((r.instrument, r.ts.hour, r.close, r.commit) for r in got.collect())


def test_appends_only_what_is_newer(spark, tmp_path):
    root = str(tmp_path / "store")
    R.append_bars(bars(spark, ("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 5.0)), root, 0, "1h")
    again = bars(spark, ("a", 1, 9.0), ("a", 2, 9.0), ("b", 1, 9.0))
    R.append_bars(again, root, 0, "1h")  # the commit itself again
    R.append_bars(again, root, 1, "1h")  # its bars under another number
    R.append_bars(bars(spark, ("a", 2, 9.0), ("a", 3, 3.0), ("c", 1, 7.0)), root, 2, "1h")
    assert stored(spark, root) == [("a", 1, 1.0, 0), ("a", 2, 2.0, 0), ("a", 3, 3.0, 2), ("b", 1, 5.0, 0), ("c", 1, 7.0, 2)]
    assert read_bars(spark, root, "1h", ["a"], columns=["close"]).count() == 3
    log = R.log_of(spark, root).where("instrument IS NOT NULL").groupBy("commit").agg(F.sum("rows")).collect()
    assert sorted(map(tuple, log)) == [(0, 3), (2, 2)]


def test_half_a_commit_is_not_seen_and_is_replaced(spark, tmp_path):
    root = str(tmp_path / "store")
    R.append_bars(bars(spark, ("a", 1, 1.0)), root, 0, "1h")
    half = bars(spark, ("a", 2, 9.0)).withColumns({"timeframe": F.lit("1h"), "commit": F.lit(1)})
    half.write.mode("append").partitionBy("timeframe", "commit").parquet(root)  # the driver was lost before the log
    assert stored(spark, root) == [("a", 1, 1.0, 0)]
    R.append_bars(bars(spark, ("a", 2, 2.0), ("a", 3, 3.0)), root, 1, "1h")
    assert stored(spark, root) == [("a", 1, 1.0, 0), ("a", 2, 2.0, 1), ("a", 3, 3.0, 1)]


def test_empty_and_faulty_commits(spark, tmp_path):
    root = str(tmp_path / "store")
    assert R.read_committed(spark, root) is None
    R.append_bars(bars(spark, ("a", 1, 1.0)).limit(0), root, 0, "1h")
    assert R.read_committed(spark, root) is None and R.log_of(spark, root).count() == 1
    with pytest.raises(ValueError, match="twice"):
        R.append_bars(bars(spark, ("a", 1, 1.0), ("a", 1, 2.0)), root, 1, "1h")
    with pytest.raises(ValueError, match="timeframe"):
        R.append_bars(bars(spark, ("a", 1, 1.0)), root, 1, "7h")
    R.append_bars(bars(spark, ("a", 1, 1.0)), root, 1, "1h")
    assert stored(spark, root) == [("a", 1, 1.0, 1)]


def test_two_runs_of_a_stream_fill_one_store(spark, tmp_path):
    """The hour that is open at the end of a run is written by the run that sees it close, once and whole."""
    root, source = str(tmp_path / "store"), str(tmp_path / "in")

    def run(*rows):
        made = spark.createDataFrame([("a", datetime(2024, 1, 1, h, m), float(v)) for h, m, v in rows], "instrument string, ts timestamp, v double")
        made.coalesce(1).write.mode("append").parquet(source)
        s = spark.readStream.schema(made.schema).parquet(source).withWatermark("ts", "0 seconds").groupBy(F.window("ts", "1 hour").alias("w"), "instrument")
        b = s.agg(F.min_by("v", "ts").alias("open"), F.max("v").alias("high"), F.min("v").alias("low"), F.max_by("v", "ts").alias("close"), F.count("v").cast("double").alias("volume"))
        R.refresh(b.select("instrument", F.col("w.end").alias("ts"), "open", "high", "low", "close", "volume"), root, "1h")
        return sorted((r.ts.hour, r.open, r.close, r.volume) for r in R.read_committed(spark, root, "1h").collect())

    assert run((1, 5, 1), (1, 50, 2), (2, 10, 3), (3, 10, 4)) == [(2, 1, 2, 2), (3, 3, 3, 1)]
    assert run((3, 40, 6), (4, 20, 7)) == [(2, 1, 2, 2), (3, 3, 3, 1), (4, 4, 6, 2)]
    assert run() == [(2, 1, 2, 2), (3, 3, 3, 1), (4, 4, 6, 2)]  # a run without news


def targets(spark, *rows):
    return spark.createDataFrame([(n, datetime(2024, 1, d), w) for n, d, w in rows], "instrument string, ts timestamp, weight double")


def asked(orders):
    return sorted((r.instrument, r.from_side, r.to_side, r.nth, r.action) for r in orders.collect())


def test_plans_order_the_change_of_side(spark, tmp_path):
    root, day = str(tmp_path / "plan"), lambda d: datetime(2024, 1, d)
    t = targets(spark, ("a", 1, 0.3), ("b", 1, -0.2), ("c", 1, 0.0), ("a", 2, -0.1), ("b", 2, -0.9), ("a", 3, 0.0), ("b", 3, 0.0), ("c", 3, 1e-13), ("d", 3, None))
    assert asked(R.plan(t, root, day(1))) == [("a", 0, 1, 0, "BUY"), ("b", 0, -1, 0, "SELL")]
    assert asked(R.plan(t, root, day(1))) == []  # planned already
    assert asked(R.plan(t, root, day(2))) == [("a", 1, -1, 0, "SELL"), ("a", 1, -1, 1, "SELL")]
    assert asked(R.plan(t, root, datetime(2024, 1, 5))) == [("a", -1, 0, 0, "BUY"), ("b", -1, 0, 0, "BUY")]
    assert len(asked(R.read_orders(spark, root))) == 6
    with pytest.raises(ValueError, match="too old"):
        R.plan(t, root, day(20))


def test_a_name_left_out_of_a_plan_is_flat_in_the_next(spark, tmp_path):
    root = str(tmp_path / "plan")
    t = targets(spark, ("a", 1, 1.0), ("b", 1, 1.0), ("b", 2, 1.0), ("a", 3, 1.0), ("b", 3, 1.0))
    for d, want in ((1, [("a", 0, 1, 0, "BUY"), ("b", 0, 1, 0, "BUY")]), (2, []), (3, [("a", 0, 1, 0, "BUY")])):
        assert asked(R.plan(t, root, datetime(2024, 1, d))) == want
