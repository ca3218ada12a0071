"""The behavior watch: state across batches, expiry, repeated batches."""

import os

import pytest
from pyspark.sql import functions as F

from tapewise.functions.exprs import DAY_MS
from tapewise.operators import behavior as H
from tapewise.streaming import watch

from test_trading import FILLS, tape

EQUITY = "user string, period string, time_ms long, account_value double, pnl double"
RULES = (("liquidated", "liquidations", 0.0, 1), ("leverage", "p95_leverage", 0.05, 1), ("martingale", "martingale_share", 0.1, 2))


def rows_of(df):
    return sorted((r.trader, r.rule, round(r.value, 9), r.n_trades, r.actionable) for r in df.collect())


@pytest.fixture(scope="module")
def world(spark):
    fills = [r for k in range(6) for r in tape(k, 60, (f"hot{k % 3}", f"cold{k}"))]
    fills = [(*r[:-2], 1000 * k + r[-2], r[-1]) for k, r in enumerate(fills)]
    users = sorted({r[0] for r in fills})
    equity = spark.createDataFrame([(u, "month", d * DAY_MS, 10_000.0, 0.0) for u in users for d in range(0, 40, 3)], EQUITY)
    return fills, equity


def expected(spark, fills, equity, now, days):
    kept = spark.createDataFrame([f for f in fills if f[1] >= now - days * DAY_MS], FILLS)
    return rows_of(H.exit_rules(H.behavior_features(kept, equity, now, days), RULES))


def test_batches_in_any_order_give_the_rules_of_all_fills(spark, tmp_path, world):
    fills, equity = world
    now, sink = 3 * DAY_MS, str(tmp_path)
    parts = [fills[2::3] + fills[:10], fills[0::3], fills[1::3] + fills[:10]]       # out of order, some twice
    for n, part in enumerate(parts):
        watch.watch_batch(spark.createDataFrame(part, FILLS), n, equity, sink, now, 30, RULES, buckets=4)
    assert rows_of(watch.current_hits(spark, sink)) == expected(spark, fills, equity, now, 30) != []
    state = watch.State(spark, f"{sink}/state", 3)
    schema = spark.createDataFrame(fills[:1], FILLS).withColumn("bucket", F.lit(1)).schema
    held = state.read(schema)
    assert held.count() == held.select("user", "tid", "oid").distinct().count()
    # Only the files of the buckets asked for are named to Spark.
    one = next(iter(state.versions))
    assert {f"bucket={one}" in f for f in state.read(schema, [one]).inputFiles()} == {True} and len(state.versions) > 1


def test_state_follows_the_window_and_repeated_batches(spark, tmp_path, world):
    fills, equity = world
    sink = str(tmp_path)
    late = [("late", 40 * DAY_MS, "BTC", "B", "Open Long", 100.0, 1.0, 0.0, 0.0, 0.1, False, 9_999_999, 1)]
    early = [f for f in fills if f[0].startswith("cold")]
    feed = lambda n, part: watch.watch_batch(spark.createDataFrame(part, FILLS), n, equity, sink, None, 30, RULES, buckets=4)
    feed(0, early)
    first = rows_of(watch.current_hits(spark, sink))
    assert first == expected(spark, early, equity, max(f[1] for f in early), 30) != []
    # A batch that stopped before its marker was complete, and is repeated.
    feed(1, late)
    os.unlink(f"{sink}/state/markers/batch=1/_SUCCESS")
    assert watch.State(spark, f"{sink}/state", 2).batch == 0
    feed(1, late)
    # Time has gone on by forty days: the users of the first batch have been looked at again, and are clear.
    assert rows_of(watch.current_hits(spark, sink)) == []
    state = watch.State(spark, f"{sink}/state", 2)
    kept = state.read(spark.createDataFrame(late, FILLS).withColumn("bucket", F.lit(1)).schema)
    assert [r.user for r in kept.collect()] == ["late"] and state.now_ms == 40 * DAY_MS
    feed(2, late)
    feed(3, late[:0])
    assert sorted(os.listdir(f"{sink}/state/markers")) == ["batch=2", "batch=3"]
    versions = {v: [b for b in os.listdir(f"{sink}/state/fills/{v}") if b.startswith("bucket=")] for v in os.listdir(f"{sink}/state/fills")}
    assert sum(map(len, versions.values())) == 1        # what no marker names is gone


def test_fills_before_the_window_are_not_stored(spark, tmp_path, world, monkeypatch):
    fills, equity = world
    written = []
    monkeypatch.setattr(watch, "shared", lambda df: written.append(df) or df.localCheckpoint())
    now = 30 * DAY_MS + sorted(f[1] for f in fills)[len(fills) // 2]
    watch.watch_batch(spark.createDataFrame(fills, FILLS), 0, equity, str(tmp_path), now, 30, RULES, buckets=2)
    with_fills = [df for df in written if "tid" in df.columns]
    assert len(with_fills) == 1 and with_fills[0].filter(F.col("time_ms") < now - 30 * DAY_MS).count() == 0
    assert rows_of(watch.current_hits(spark, str(tmp_path))) == expected(spark, fills, equity, now, 30)
