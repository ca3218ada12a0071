"""What is shuffled and written grows no faster than the input."""

from pyspark.sql import functions as F

from tapewise.functions import ranks as K
from tapewise.operators import backtest as B
from tapewise.operators import behavior as H
from tapewise.operators.latest import dedup_fills

FILL = ("user string, time_ms long, coin string, side string, dir string, px double, sz double, start_position double, "
        "closed_pnl double, fee double, liquidated boolean, oid long, tid long")


def fills(spark):
    make = lambda u, t, px, tid: (u, t, "BTC", "B", "Open Long", px, 1.0, 0.0, 0.0, 0.0, False, 7, tid)
    return spark.createDataFrame([
        make("a", 10, 5.0, 1), make("a", 10, 4.0, 1),       # before the window, differing copies
        make("a", 40, 3.0, 2), make("a", 90, 2.0, 2),       # the earlier copy counts, and lies before the window
        make("a", 120, 9.0, 3), make("a", 120, 8.0, 3),     # inside: the smaller row
        make("b", 130, 1.0, 4)], FILL)


def test_fills_before_the_window_are_shuffled_without_details(spark):
    whole = {(r.user, r.tid): r for r in dedup_fills(fills(spark)).collect()}
    got = {(r.user, r.tid): r for r in dedup_fills(fills(spark), 50).collect()}
    assert {k: (r.time_ms, r.coin, r.dir) for k, r in got.items()} == {k: (r.time_ms, r.coin, r.dir) for k, r in whole.items()}
    assert [got["a", 3], got["b", 4]] == [whole["a", 3], whole["b", 4]] and got["a", 3].px == 8.0
    assert got["a", 1].px is None and got["a", 2].px is None and whole["a", 2].px == 3.0


def test_fills_of_a_user_go_to_a_few_tasks(spark):
    many = spark.range(4000).select(
        F.concat(F.lit("u"), F.floor(F.col("id") / 4000)).alias("user"), F.col("id").alias("time_ms"), F.lit("BTC").alias("coin"), F.lit("B").alias("side"), F.lit("Open Long").alias("dir"),
        *[F.lit(1.0).alias(c) for c in ("px", "sz", "start_position", "closed_pnl", "fee")], F.lit(False).alias("liquidated"),
        F.col("id").alias("oid"), F.col("id").alias("tid"))
    plan = dedup_fills(many)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(user" in plan and "_deal" in plan and "SortAggregate" not in plan
    assert dedup_fills(many).count() == 4000


def test_medians_of_ordinary_and_large_groups(spark):
    df = spark.range(300).select(F.concat(F.lit("u"), (F.col("id") % 7 % 3).cast("string")).alias("user"),
                                 F.when(F.col("id") % 5 != 0, F.col("id") * 37 % 101 - 50.5).alias("x"), (F.col("id") * 11 % 13).alias("y"))
    ask = lambda rows: sorted(H.medians_by_user(df, {"x": F.col("x"), "y": F.col("y")}, {"p95": 0.95}, rows=rows).collect())
    assert ask(1000) == ask(100) == ask(1)
    plan = K.collected_quantiles(df, ["user"], {"x": F.col("x"), "y": F.col("y")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    none = df.select("user", F.lit(None).cast("double").alias("x")).limit(3)
    assert all(r.x is None for r in H.medians_by_user(none, {"x": F.col("x")}).collect())


def test_wanted_features_are_those_of_all(spark):
    equity = spark.createDataFrame([("a", "allTime", 100, 50.0, 0.0), ("b", "allTime", 100, 50.0, 0.0)],
                                   "user string, period string, time_ms long, account_value double, pnl double")
    now = 50 + H.DAY_MS
    whole = H.behavior_features(fills(spark), equity, now, 1, 1)
    some = H.behavior_features(fills(spark), equity, now, 1, 1, wanted=["top_coin_share"])
    assert "change_size" in whole.columns and "change_size" not in some.columns and "p95_leverage" not in some.columns
    assert sorted(whole.select(some.columns).collect()) == sorted(some.collect())
    assert {r.user: (r.first_fill_ms, r.fills_total) for r in some.collect()} == {"a": (10, 3), "b": (130, 1)}


def test_steps_are_dealt_out_before_they_are_repeated(spark):
    week = 7 * 86_400_000
    rows = [(u, i * 2 * week, None if (i + u) % 5 == 0 else 0.01 * ((i * 7 + u) % 11 - 4), 1.0, 100.0 + i + u if i % 4 else None)
            for u in range(4) for i in range(30)]
    returns = spark.createDataFrame(rows, "user long, end_ms long, ret double, dpnl double, account_value double").withColumn(
        "user", F.col("user").cast("string"))
    out = B.eligible_signals(returns, min_account=0.0)
    assert "hashpartitioning(formation_ms" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():     # the account value of the last step in the lookback
        assert r.account_value == max((e, av) for u, e, _, _, av in rows if str(u) == r.user and r.formation_ms - 12 * week < e <= r.formation_ms)[1]
    assert out.count() > 20
