"""Returns, signals, scores and backtests on hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from tapewise.functions.exprs import DAY_MS, HOUR_MS, WEEK_MS
from tapewise.operators import accumulate as A
from tapewise.operators import backtest as B
from tapewise.operators import returns as R
from tapewise.operators import score as C
from tapewise.operators import signals as S

SUNDAY = 1_736_035_200_000      # 2025-01-05
STEP = 2 * WEEK_MS
EQUITY = "user string, period string, time_ms long, account_value double, pnl double"


def curve(spark, points, perp=None):
    rows = []
    for i, (av, pnl) in enumerate(points):
        t = SUNDAY + i * STEP - HOUR_MS
        rows += [("a", "allTime", t, float(av), float(pnl)), ("a", "perpAllTime", t, float(av), float(pnl if perp is None else perp[i]))]
    return spark.createDataFrame(rows, EQUITY)


@pytest.mark.parametrize("points, perp, want", [
    ([(1500, 0), (221_500, 20_000)], None, 20_000 / 201_500),              # a deposit counts from the start
    ([(1_700_000, 0), (1_600_000, 3_100_000)], None, 3.1 / 1.7),           # withdrawn profit does not shrink capital
    ([(10_000, 0), (20_000, 10_000)], [0, 5_000], 0.5),                    # spot gains are not trading skill
    ([(1000, 0), (1000, -30_000)], None, -30_000 / 31_000),                # losses above the capital imply a deposit
    ([(1000, 0), (1000, -30_000)], [0, -50_000], -1.0),                    # floored
    ([(900, 0), (1900, 1000)], None, None),                                # too small to start with
])
def test_period_returns(spark, points, perp, want):
    got = [r.ret for r in R.period_returns(curve(spark, points, perp)).orderBy("end_ms").collect()]
    assert got[0] is None
    assert got[1] == (None if want is None else pytest.approx(want, abs=1e-9))


def test_origin_point_and_gap_are_not_observations(spark):
    origin = spark.createDataFrame([("a", p, SUNDAY - STEP - HOUR_MS, 0.0, 0.0) for p in ("allTime", "perpAllTime")], EQUITY)
    got = R.period_returns(curve(spark, [(10_000, 0), (10_100, 100)]).unionByName(origin)).collect()
    assert sorted(r.ret for r in got if r.ret is not None) == [pytest.approx(0.01)]
    # A missing observation repeats the previous one: no return, rather than zero.
    sparse = curve(spark, [(10_000, 0), (10_100, 100), (10_200, 200)]).filter(F.col("time_ms") != SUNDAY + STEP - HOUR_MS)
    assert [r.ret for r in R.period_returns(sparse).orderBy("end_ms").collect()][:2] == [None, None]


def world(spark, users=60, steps=30, skill=0.02, seed=5):
    r = random.Random(seed)
    rows = []
    for u in range(users):
        mu = r.gauss(0, skill)
        rows += [(f"u{u:03d}", SUNDAY + i * STEP, 50_000.0, 0.0, 100.0, max(-0.9, mu + r.gauss(0, 0.02))) for i in range(steps)]
    return spark.createDataFrame(rows, "user string, end_ms long, account_value double, pnl double, dpnl double, ret double")


def test_skill_persists_and_luck_does_not(spark):
    table = {r.signal: r for r in S.summarize(S.retroactive_persistence(world(spark))).collect()}
    assert table["sharpe"].mean_ic > 0.3 and table["sharpe"].ic_tstat > 3
    assert abs(table["random"].mean_ic) < 0.2
    assert table["sharpe"].periods == 11


def test_no_look_ahead(spark):
    w = world(spark, 20, 20)
    cut = SUNDAY + 10 * STEP
    later = w.withColumn("ret", F.when(F.col("end_ms") > cut, -F.col("ret")).otherwise(F.col("ret")))
    at = lambda d: sorted(tuple(r) for r in S.signals_at(d, cut, 12, 4).select("user", F.round("sharpe", 9), F.round("low_dd", 9)).collect())
    assert at(w) == at(later)


def test_signal_definitions(spark):
    rets = [0.1, -0.2, 0.05, 0.0]
    rows = [("a", SUNDAY + i * STEP, 0.0, 0.0, 1.0, x) for i, x in enumerate(rets)]
    df = spark.createDataFrame(rows, "user string, end_ms long, account_value double, pnl double, dpnl double, ret double")
    s = S.signals_at(df, SUNDAY + 3 * STEP, 12, 4).collect()[0]
    assert s.n_obs == 4 and s.consistency == 0.5 and s.max_abs_ret == 0.2 and s.pnl_usd == 4
    assert s.ret == pytest.approx(1.1 * 0.8 * 1.05 - 1)
    assert s.low_dd == pytest.approx(-0.2)          # an initial loss would not be a drawdown, a later one is
    assert s.stability == pytest.approx(-abs((0.1 - 0.2) / 2 - 0.025))
    assert s.profit_factor == pytest.approx(0.15 / 0.2)


def test_backtest_missing_turnover_and_costs(spark):
    w = world(spark, 12, 14)
    sig = B.eligible_signals(w)
    picks = B.stack_selections(best=C.top_by(sig, "sharpe", 3))
    free = B.copy_backtest(w, picks, ["best"], rebalance_cost=0.0).orderBy("formation_ms").collect()
    dear = B.copy_backtest(w, picks, ["best"], rebalance_cost=0.01).orderBy("formation_ms").collect()
    assert free[0].turnover == 1.0 and all(a.net_ret > b.net_ret for a, b in zip(free, dear))
    ghost = spark.createDataFrame([("best", free[0].formation_ms, "nobody")], "strategy string, formation_ms long, user string")
    row = B.copy_backtest(w, ghost, ["best"]).orderBy("formation_ms").collect()
    assert (row[0].n_selected, row[0].n_missing, row[0].gross_ret) == (1, 1, 0.0)
    assert row[1].n_selected == 0 and row[1].turnover is None and row[1].net_ret == 0.0


def test_metrics(spark):
    nets = [0.1, -0.05, -0.05, 0.2]
    rows, eq = [], 1.0
    for i, n in enumerate(nets):
        eq *= 1 + n
        rows.append(("s", i, 1, 0, 0.5, n, eq))
    df = spark.createDataFrame(rows, "strategy string, formation_ms long, n_selected int, n_missing int, turnover double, net_ret double, equity double")
    m = B.summarize_backtest(df).collect()[0]
    assert m.periods == 4 and m.recovery_periods == 2 and m.hit_rate == 0.5
    assert m.max_drawdown == pytest.approx(0.95 * 0.95 - 1) and m.profit_factor == pytest.approx(0.3 / 0.1)
    assert m.cagr == pytest.approx(eq ** (13 / 4) - 1)


SIG = "formation_ms long, user string, n_obs long, max_abs_ret double, ret double, vol double, sharpe double, low_dd double, consistency double, stability double"


def test_score_penalties_and_exclusions(spark):
    rows = [(0, "good", 6, 0.1, 0.2, 0.02, 2.0, -0.01, 0.9, -0.01), (0, "mid", 5, 0.1, 0.1, 0.02, 1.0, -0.05, 0.6, -0.02),
            (0, "bad", 4, 0.2, -0.1, 0.03, -1.0, -0.3, 0.2, -0.2), (0, "levered", 6, 1.5, 3.0, 0.9, 3.0, -0.5, 0.8, -0.3),
            (0, "flat", 4, 0.0, 0.0, 0.0, float("nan"), -0.4, 0.0, -0.3)]
    sig = spark.createDataFrame(rows, SIG)
    s = {r.user: r.trader_score for r in C.score_from_signals(sig).collect()}
    assert s["levered"] is None and s["good"] > s["mid"] > s["bad"] > s["flat"]
    assert s["good"] == pytest.approx(100.0)
    beh = spark.createDataFrame([("good", 1, 0.7, 20.0, 0.9), ("mid", 0, 0.1, 2.0, 0.3)],
                                "user string, liquidations long, martingale_share double, p95_leverage double, top_coin_share double")
    p = {r.user: r for r in C.score_from_signals(sig, beh).collect()}
    assert p["good"].behavior_penalty == 40 and p["good"].trader_score == pytest.approx(60.0)
    assert not p["bad"].behavior_known and p["bad"].behavior_penalty == 0
    x = {r.user: r for r in C.behavior_exclusions(sig, beh).collect()}
    assert x["good"].exclusion_reason == "liquidations" and not x["mid"].behavior_excluded and not x["bad"].behavior_excluded


def test_accumulation_rules(spark):
    rows = []
    for d in range(500):
        for coin, px in (("BTC", 100.0 * 1.001 ** d), ("STRONG", 10.0 * 1.004 ** d), ("DEAD", 50.0 * (0.02 if d > 300 else 1.0)),
                         ("GONE", 5.0), ("FRESH", 7.0), ("THIN", 3.0)):
            if (coin == "GONE" and d >= 250) or (coin == "FRESH" and d < 440):
                continue
            rows.append(("s1", coin, d * DAY_MS, px, 1.0 if coin == "THIN" else 1e7))
            rows.append(("s0", coin, d * DAY_MS, px * 9, 1e7))      # superseded
    closes = A.daily_closes(spark.createDataFrame(rows, "snapshot_at string, coin string, time_ms long, close double, volume double"))
    feats = A.coin_features(closes)
    last = feats.agg(F.max("day_at")).collect()[0][0]
    now = {r.coin: r for r in feats.filter(F.col("day_at") == last).collect()}
    assert {c for c, r in now.items() if r.eligible} == {"BTC", "STRONG"}
    assert now["STRONG"].momentum > 0 and abs(now["BTC"].momentum) < 1e-9 and now["GONE"].fall_from_high90 == 0.0
    table = A.accumulate_backtest(closes, {"strong": ("strong", 1), "btc": ("btc_only", 1)}, cost=0.0, features=feats)
    final = {r.strategy: r.equity for r in table.orderBy("formation_ms").collect()}
    assert final["strong"] > final["btc"] > 1


def test_benchmark_of_one_interval_whatever_the_slices(spark):
    minutes = [("BTC", "1m", t * 60_000, float(100 + t % 97), "a") for t in range(500)]
    days = [("BTC", "1d", t * 60_000, 1000.0 + t, "b") for t in range(0, 500, 50)]
    candles = spark.createDataFrame(minutes + days + [("ETH", "1m", 0, 5.0, "a")], "coin string, interval string, time_ms long, close double, snapshot_at string")
    ends = spark.createDataFrame([(e,) for e in (-5, 30_000, 100 * 60_000, 100 * 60_000, 499 * 60_000)], "end_ms long")
    want = lambda close: [(-5, None), (30_000, None), (6_000_000, close(100) / close(0) - 1), (29_940_000, close(499) / close(100) - 1)]
    for rows in (7, 1_000_000):
        got = lambda interval: sorted((r.end_ms, r.btc_ret) for r in R.benchmark_step_returns(candles, ends, "BTC", interval, rows).collect())
        assert got("1m") == want(lambda t: 100.0 + t % 97) and got("1d") == want(lambda t: 1000.0 + t // 50 * 50)
    px = candles.filter("interval = '1m' and coin = 'BTC'")
    dates = spark.createDataFrame([(60_000, 120_000), (-9, 60_000)], "formation_ms long, end_ms long")
    got = {(r.end_ms): r.p for r in B.price_asof(px, dates, "end_ms", "p", 7).collect()}
    assert got == {120_000: 102.0, 60_000: 101.0}
    assert [round(r.gross_ret, 9) for r in B.buy_and_hold(px, dates).orderBy("formation_ms").collect()] == [0.0, round(102 / 101 - 1, 9)]
