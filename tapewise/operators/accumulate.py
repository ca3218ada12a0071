"""Coin accumulation rules over daily candles, at all formation dates in one job.

After deduplication a coin has one row per day, so every per-coin window is calendar-sized."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import DAY_MS, ratio
from ..functions.ranks import top_n
from ..session import shared
from .backtest import with_equity
from .latest import keep_one
from .score import random_pick, top_by

# Fixed values of the quality filter and the study
MIN_AGE_DAYS = 180
MIN_NOTIONAL = 1_000_000.0
MAX_FALL_FROM_ATH = 0.95
STALE_DAYS = 3
MOMENTUM_DAYS = 182
FALLEN_DAYS = 90
NOTIONAL_DAYS = 30
HOLD_WEEKS = 4
COST_PER_TURNOVER = 0.0015
BENCHMARK = "BTC"


def daily_closes(candles: DataFrame) -> DataFrame:
    """One row per (coin, day): the newest snapshot's close and its notional volume."""
    return keep_one(candles.select("coin", "time_ms", "snapshot_at", "close", "volume"), ["coin", "time_ms"],
                    F.col("snapshot_at"), last=True).select(
        "coin", F.floor(F.col("time_ms") / DAY_MS).cast("int").alias("day"), "close",
        (F.col("close") * F.col("volume")).alias("notional"))


def formation_days(closes: DataFrame, benchmark: str = BENCHMARK, hold_weeks: int = HOLD_WEEKS) -> DataFrame:
    """Formation days (days since the epoch) from 26 weeks after the benchmark's first candle."""
    hold = 7 * hold_weeks
    span = closes.filter(F.col("coin") == benchmark).agg((F.min("day") + MOMENTUM_DAYS).alias("a"),
                                                         (F.max("day") - hold).alias("b"))
    return span.filter(F.col("a") <= F.col("b")).select(F.explode(F.sequence("a", "b", F.lit(hold))).alias("day_at"))


def _expand(closes: DataFrame, first, last, hold: int, reach: int) -> DataFrame:
    """Each candle once per formation it can matter to: day <= at <= day + reach."""
    rows = closes.withColumn("_a", first).withColumn("_b", last)
    lo = F.greatest(F.lit(0), F.ceil((F.col("day") - F.col("_a")) / hold)).cast("int")
    hi = F.floor((F.least(F.col("day") + reach, F.col("_b")) - F.col("_a")) / hold).cast("int")
    return (rows.withColumn("_lo", lo).withColumn("_hi", hi).filter(F.col("_lo") <= F.col("_hi"))
            .withColumn("_k", F.explode(F.sequence("_lo", "_hi"))).withColumn("day_at", F.col("_a") + F.col("_k") * hold)
            .withColumn("age", F.col("day_at") - F.col("day")).drop("_a", "_b", "_lo", "_hi", "_k"))


def coin_features(closes: DataFrame, benchmark: str = BENCHMARK, hold_weeks: int = HOLD_WEEKS,
                  min_age_days: int = MIN_AGE_DAYS, min_notional: float = MIN_NOTIONAL) -> DataFrame:
    """Eligibility, momentum against the benchmark and fall from the 90-day high, per coin and
    formation day, from candles at or before that day only.

    A candle is expanded to the few formations within reach; a coin whose last candle is out of reach
    keeps a row that is not eligible."""
    closes = shared(closes)
    hold = 7 * hold_weeks
    days = formation_days(closes, benchmark, hold_weeks)
    first, last = days.agg(F.min("day_at")).scalar(), days.agg(F.max("day_at")).scalar()
    w = Window.partitionBy("coin").orderBy("day")
    hist = closes.withColumn("_ath", F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "_born", F.min("day").over(Window.partitionBy("coin")))
    reach = MOMENTUM_DAYS + STALE_DAYS
    rows = _expand(hist, first, last, hold, reach)
    age = F.col("age")
    then_age = F.when((age >= MOMENTUM_DAYS) & (age <= reach), F.col("day"))
    recent = F.sort_array(F.collect_list(F.when(age <= NOTIONAL_DAYS, F.col("notional"))))   # at most 31 values
    feats = rows.groupBy("coin", "day_at").agg(
        F.max_by("close", "day").alias("now"), F.max_by("_ath", "day").alias("ath"), F.max("_born").alias("born"),
        F.min("age").alias("stale"), F.max_by("close", then_age).alias("then"),
        F.max(F.when(age <= FALLEN_DAYS, F.col("close"))).alias("high90"), recent.alias("notionals"))
    median = F.try_element_at("notionals", (F.floor(F.size("notionals") / 2) + 1).cast("int"))
    bench = feats.filter(F.col("coin") == benchmark).select(
        "day_at", F.when(F.col("stale") <= STALE_DAYS, F.col("now")).alias("b_now"), F.col("then").alias("b_then"))
    momentum = ratio(ratio(F.col("now"), F.col("then")), ratio(F.col("b_now"), F.col("b_then"))) - 1
    eligible = ((F.col("day_at") - F.col("born") >= min_age_days)
                & (F.coalesce(median, F.lit(0.0)) >= min_notional)
                & (F.col("now") > F.col("ath") * (1 - MAX_FALL_FROM_ATH)) & (F.col("stale") <= STALE_DAYS))
    feats = feats.join(bench, "day_at", "left").select(
        "coin", "day_at", eligible.alias("eligible"), momentum.alias("momentum"),
        (ratio(F.col("now"), F.coalesce("high90", "now")) - 1).alias("fall_from_high90"))
    every = _expand(closes.groupBy("coin").agg(F.min("day").alias("day")), first, last, hold, 1 << 20)
    return every.select("coin", "day_at").join(feats, ["coin", "day_at"], "left").select(
        "coin", "day_at", F.coalesce("eligible", F.lit(False)).alias("eligible"), "momentum",
        F.coalesce("fall_from_high90", F.lit(0.0)).alias("fall_from_high90"))


def accumulate_selection(features: DataFrame, rule: str, n: int = 5, benchmark: str = BENCHMARK, seed: int = 0) -> DataFrame:
    """The coins a rule holds from each formation day (day_at, coin)."""
    pool = features.filter("eligible").withColumn("user", F.col("coin"))
    keys = ["day_at"]
    if rule == "btc_only":
        picked = features.filter(F.col("coin") == benchmark)
    elif rule == "everything":
        picked = pool
    elif rule == "random":
        picked = random_pick(pool, n, seed, keys, draw=keys).withColumnRenamed("user", "coin")
    elif rule == "strong":
        picked = top_by(pool, "momentum", n, keys=keys).withColumnRenamed("user", "coin")
    elif rule == "fallen":
        picked = top_n(pool, keys, [F.col("fall_from_high90").asc(), F.col("coin").asc()], n)
    else:
        raise ValueError(rule)
    return picked.select("day_at", "coin")


def accumulate_backtest(closes: DataFrame, rules: dict[str, tuple[str, int]], benchmark: str = BENCHMARK,
                        hold_weeks: int = HOLD_WEEKS, cost: float = COST_PER_TURNOVER, seed: int = 0,
                        features: DataFrame | None = None, **filters) -> DataFrame:
    """Period table of several rules (name -> (rule, n)). A missing entry price earns 0; a coin without
    a recent exit price is valued at its last close and counted missing."""
    closes = shared(closes)
    hold = 7 * hold_weeks
    feats = shared(features if features is not None else coin_features(closes, benchmark, hold_weeks, **filters))
    chosen = None
    for name, (rule, n) in rules.items():
        part = accumulate_selection(feats, rule, n, benchmark, seed).withColumn("strategy", F.lit(name))
        chosen = part if chosen is None else chosen.unionByName(part)
    w = Window.partitionBy("strategy", "coin").orderBy("day_at")
    chosen = chosen.withColumn("kept", F.coalesce(F.lag("day_at").over(w) == F.col("day_at") - hold, F.lit(False)))
    days = formation_days(closes, benchmark, hold_weeks)
    # Closes as of every boundary day: a calendar-sized window per coin.
    first, last = days.agg(F.min("day_at")).scalar(), days.agg(F.max("day_at")).scalar()
    bounds = _expand(closes.groupBy("coin").agg(F.min("day").alias("day")), first, last + F.lit(hold), hold, 1 << 20)
    rows = closes.select("coin", "day", "close", F.lit(0).alias("side")).unionByName(
        bounds.select("coin", F.col("day_at").alias("day"), F.lit(1).alias("side")), allowMissingColumns=True)
    upto = Window.partitionBy("coin").orderBy("day", "side").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("side") == 0, F.struct("day", "close")), ignorenulls=True).over(upto)
    price = rows.withColumn("p", seen).filter(F.col("side") == 1).select(
        "coin", "day", F.col("p.close").alias("last"),
        F.when(F.col("day") - F.col("p.day") <= STALE_DAYS, F.col("p.close")).alias("fresh"))
    price = shared(price)
    p0 = price.select("coin", F.col("day").alias("day_at"), F.col("fresh").alias("p0"))
    p1 = price.select("coin", (F.col("day") - hold).alias("day_at"), F.col("fresh").alias("p1"), F.col("last").alias("p1_last"))
    rows = chosen.join(p0, ["coin", "day_at"], "left").join(p1, ["coin", "day_at"], "left")
    n = F.count(F.lit(1))
    per = rows.groupBy("strategy", "day_at").agg(
        n.alias("n_selected"), F.count_if(F.col("p1").isNull()).alias("n_missing"),
        F.avg(F.when(F.col("kept"), 0.0).otherwise(1.0)).alias("turnover"),
        (F.sum(F.coalesce(ratio(F.coalesce("p1", "p1_last"), F.col("p0")) - 1, F.lit(0.0))) / n).alias("gross_ret"))
    every = days.select("day_at", F.explode(F.array(*[F.lit(s) for s in rules])).alias("strategy"))
    gross = F.coalesce("gross_ret", F.lit(0.0))
    net = F.when(F.col("n_selected") > 0, (1 + gross) * (1 - cost * F.col("turnover")) - 1).otherwise(0.0)
    out = every.join(per, ["strategy", "day_at"], "left").select(
        "strategy", (F.col("day_at").cast("long") * DAY_MS).alias("formation_ms"),
        ((F.col("day_at").cast("long") + hold) * DAY_MS).alias("end_ms"),
        F.coalesce("n_selected", F.lit(0)).cast("long").alias("n_selected"),
        F.coalesce("n_missing", F.lit(0)).cast("long").alias("n_missing"), "turnover",
        gross.alias("gross_ret"), net.alias("net_ret"))
    return with_equity(out)


def benchmark_since(candles: DataFrame, start_ms: int, coin: str = BENCHMARK) -> DataFrame:
    """Benchmark return from the close at or before a time until the last close."""
    bars = candles.filter(F.col("coin") == coin)
    key = F.struct("time_ms", "snapshot_at")
    out = bars.agg(F.max_by("close", key).alias("last"),
                   F.max_by("close", F.when(F.col("time_ms") <= start_ms, key)).alias("start"))
    return out.filter(F.col("start").isNotNull()).select("start", "last", (ratio(F.col("last"), F.col("start")) - 1).alias("ret"))
