"""Choices among candidates: what a switch turns over is paid for, a window without a choice holds nothing."""

from datetime import datetime, timedelta

from ravelin.plans.evaluate import pick

DAY0 = datetime(2020, 1, 1)


def records(spark, *rows):
    """Records of 365 + 91 * 2 days: (key, config, return of the odd days before the second window, after it, position)."""
    out = []
    for key, config, first, then, position in rows:
        for d in range(365 + 182):
            r = (first if d < 365 else then) * (1.0 if d % 2 else 0.5)
            out.append((key, config, DAY0 + timedelta(days=d), r, position))
    return spark.createDataFrame(out, "key string, config int, day timestamp, r double, position double")


def test_a_switch_pays_for_what_changes_hands(spark):
    """Candidate 0 is the best of the first year; in the window after it loses so much that 1 is taken, long after short."""
    rec = records(spark, ("a", 0, 0.002, -0.05, 1.0), ("a", 1, 0.001, 0.001, -0.5))
    chosen, days = pick(rec, 0.01)
    assert sorted((r.fold, r.config) for r in chosen.collect()) == [(0, 0), (1, 1)]
    got = {(r.day - DAY0).days: r for r in days.collect()}
    assert len(got) == 182 and got[365].config == 0 and got[456].config == 1
    assert abs(got[365].r - -0.05) < 1e-12  # the first window pays nothing
    assert abs(got[456].r - (1.0005 * (1 - 0.01 * 1.5) - 1)) < 1e-12
    assert abs(got[457].r - 0.001) < 1e-12 and got[456].position == -0.5


def test_keys_choose_for_themselves_and_may_hold_nothing(spark):
    rec = records(spark, ("a", 0, 0.002, 0.002, 1.0), ("b", 0, 0.0, 0.0, 0.0))
    chosen, days = pick(rec, 0.01)
    assert {r.key for r in chosen.collect()} == {"a"}
    b = days.where("key = 'b'").collect()
    assert len(b) == 182 and all(r.r == 0 and r.position == 0 and r.config is None for r in b)
