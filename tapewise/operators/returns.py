"""Return series on a common step grid.

Observations are reduced to the last one per (user, grid step) before anything is shuffled, so the
windows that follow see at most one row per step of the calendar however active a user is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import DAY_MS, WEEK_MS, ratio, sunday_ceil_ms, week_floor_ms
from ..functions.scan import ROWS_PER_BUCKET, asof, previous
from .latest import keep_one, last_in_bucket, latest_by_snapshot

DEFAULT_COMMISSION = 0.10      # fixed value: leader share assumed where a vault does not state one


def grid_origin(times: DataFrame, at: str = "time_ms") -> Column:
    """First Sunday 00:00 UTC at or after the earliest date, as a scalar subquery."""
    return times.agg(sunday_ceil_ms(F.min(at)).alias("origin")).scalar()


def step_grid(times: DataFrame, at: str = "time_ms", step_weeks: int = 2) -> DataFrame:
    """The common grid: one row per step end, from the first Sunday to a day past the last time."""
    step = step_weeks * WEEK_MS
    bounds = times.agg(sunday_ceil_ms(F.min(at)).alias("lo"), (F.max(at) + DAY_MS).alias("hi"))
    return (bounds.filter(F.col("lo") <= F.col("hi"))
            .select(F.explode(F.sequence("lo", "hi", F.lit(step))).alias("end_ms")))


def entity_grid(times: DataFrame, by: Sequence[str] = ("user",), at: str = "time_ms", step_weeks: int = 2) -> DataFrame:
    """Grid points inside each entity's observed range (its last day included)."""
    step = step_weeks * WEEK_MS
    origin = grid_origin(times, at)
    bounds = times.groupBy(*by).agg(F.min(at).alias("lo"), (F.max(at) + DAY_MS).alias("hi")).withColumn("o", origin)
    first = F.greatest(F.col("o"), F.col("o") + F.ceil((F.col("lo") - F.col("o")) / step) * step).cast("long")
    return (bounds.withColumn("first", first).filter(F.col("first") <= F.col("hi"))
            .select(*by, F.explode(F.sequence("first", "hi", F.lit(step))).alias("end_ms")))


def period_returns(equity: DataFrame, pnl_period: str = "perpAllTime", capital_period: str = "allTime",
                   step_weeks: int = 2, min_account: float = 1_000.0) -> DataFrame:
    """Perp-trading returns per user on the common grid.

    Return = change of cumulative perp PnL over the step / (total capital at its start + net deposits
    during it), floored at -100%. Null where the start is under `min_account`, where withdrawals leave
    under half of that, or where a boundary repeats the previous observation.

    equity: user, period, time_ms, account_value, pnl, one row per (user, period, time_ms).
    Returns user, end_ms, account_value, pnl, dpnl, ret."""
    step = step_weeks * WEEK_MS
    tolerance = step + 7 * DAY_MS
    # The synthetic (0, 0) origin of a history is not an observation.
    seen = equity.filter(F.col("period").isin(pnl_period, capital_period)
                         & ~((F.col("account_value") == 0) & (F.col("pnl") == 0)))
    is_capital = F.col("period") == capital_period
    is_pnl = F.col("period") == pnl_period
    origin = grid_origin(seen.filter(is_capital))
    # Step 0 ends at the origin; an observation belongs to the first boundary at or after it.
    steps = seen.withColumn("_o", origin).withColumn(
        "_step", F.ceil((F.col("time_ms") - F.col("_o")) / step).cast("long"))
    cap_t, pnl_t = F.when(is_capital, F.col("time_ms")), F.when(is_pnl, F.col("time_ms"))
    per_step = steps.groupBy("user", "_step").agg(
        F.max("_o").alias("_o"),
        F.min(cap_t).alias("_lo"), F.max(cap_t).alias("ts"),
        F.max_by("account_value", cap_t).alias("av"), F.max_by("pnl", cap_t).alias("pnl_total"),
        F.max(pnl_t).alias("ts_perp"), F.max_by("pnl", pnl_t).alias("perp"))
    w = Window.partitionBy("user").orderBy("_step")
    upto, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("user")
    filled = per_step.select(
        "user", "_step", "_o",
        F.min("_lo").over(whole).alias("_lo"), F.max("ts").over(whole).alias("_hi"),
        F.lead("_step").over(w).alias("_next"),
        *[F.last(c, ignorenulls=True).over(upto).alias(c) for c in ("ts", "ts_perp")],
        # A null value of an observed point stays null: it is carried together with its time.
        *[F.last(F.when(F.col(t).isNotNull(), F.struct(F.col(c).alias("v"))), ignorenulls=True).over(upto).alias(c)
          for c, t in (("av", "ts"), ("pnl_total", "ts"), ("perp", "ts_perp"))])
    # Fill the boundaries up to the next observed step, inside the observed range only.
    last_step = F.floor((F.col("_hi") + DAY_MS - F.col("_o")) / step).cast("long")
    first_step = F.greatest(F.lit(0), F.ceil((F.col("_lo") - F.col("_o")) / step)).cast("long")
    lo, hi = F.greatest(F.col("_step"), first_step), F.least(F.coalesce(F.col("_next") - 1, last_step), last_step)
    grid = (filled.withColumn("_from", lo).withColumn("_to", hi).filter(F.col("_from") <= F.col("_to"))
            .withColumn("_k", F.explode(F.sequence("_from", "_to")))
            .withColumn("end_ms", F.col("_o") + F.col("_k") * step))
    fresh = lambda t: F.col("end_ms") - F.col(t) <= tolerance
    g = grid.select(
        "user", "end_ms",
        F.when(fresh("ts"), F.col("ts")).alias("ts"), F.when(fresh("ts_perp"), F.col("ts_perp")).alias("ts_perp"),
        F.when(fresh("ts"), F.col("av.v")).alias("account_value"),
        F.when(fresh("ts"), F.col("pnl_total.v")).alias("pnl_total"),
        F.when(fresh("ts_perp"), F.col("perp.v")).alias("pnl"))
    by_end = Window.partitionBy("user").orderBy("end_ms")
    prev = {c: F.lag(c).over(by_end) for c in ("ts", "ts_perp", "account_value", "pnl_total", "pnl")}
    g = g.select("*", *[c.alias(f"_p_{n}") for n, c in prev.items()])
    dpnl = F.col("pnl") - F.col("_p_pnl")
    flow = F.col("account_value") - F.col("_p_account_value") - (F.col("pnl_total") - F.col("_p_pnl_total"))
    capital = F.col("_p_account_value") + F.greatest(flow, F.lit(0.0))
    valid = ((F.col("_p_account_value") >= min_account) & (capital >= 0.5 * min_account)
             & (F.col("ts") != F.col("_p_ts")) & (F.col("ts_perp") != F.col("_p_ts_perp")))
    # Like the floor in the definition, a missing PnL change on a valid step reads as -100%.
    ret = F.when(valid, F.greatest(ratio(dpnl, capital), F.lit(-1.0)))
    return g.select("user", "end_ms", "account_value", "pnl", dpnl.alias("dpnl"), ret.alias("ret"))


def net_of_commission(returns: DataFrame, vault_meta: DataFrame, default: float = DEFAULT_COMMISSION) -> DataFrame:
    """Vault returns after the leader's commission on gains (latest terms per vault)."""
    terms = latest_by_snapshot(vault_meta.select("vault_address", "snapshot_at", "leader_commission"),
                               ["vault_address"]).select(F.col("vault_address").alias("user"),
                                                         F.col("leader_commission").alias("_c"))
    cut = F.coalesce(F.col("_c"), F.lit(default))
    net = F.col("ret") - cut * F.greatest(F.col("ret"), F.lit(0.0))
    return (returns.join(terms, "user", "left")
            .withColumn("ret", F.when(F.col("ret").isNotNull(), net)).drop("_c"))


def weekly_returns_from_ratio(pnl: DataFrame, traders: DataFrame) -> DataFrame:
    """Weekly returns from an accumulated pnl ratio: r = (1 + R) / (1 + R_before) - 1, week ends Monday."""
    daily = keep_one(pnl, ["user", "time_ms"])
    weekly = last_in_bucket(daily, ["user"], "time_ms", ["pnl", "pnl_ratio"],
                            bucket=week_floor_ms(F.col("time_ms")) + WEEK_MS, bucket_name="end_ms")
    aum = traders.groupBy("user").agg(F.max_by("aum", "snapshot_at").alias("account_value"))
    w = Window.partitionBy("user").orderBy("end_ms")
    growth = ratio(1 + F.col("pnl_ratio"), 1 + F.lag("pnl_ratio").over(w))
    return weekly.join(aum, "user", "left").select(
        "user", "end_ms", "account_value", "pnl",
        (F.col("pnl") - F.lag("pnl").over(w)).alias("dpnl"), (growth - 1).alias("ret"))


def benchmark_step_returns(candles: DataFrame, ends: DataFrame, coin: str = "BTC", interval: str | None = "1d",
                           rows: int = ROWS_PER_BUCKET) -> DataFrame:
    """Benchmark return over each distinct step end: closes as-of the end, however old.

    Of candles with an `interval`, those of the given one (None: all). One coin's series is one entity of the ordered scans, which
    cut it into slices of `rows` rows when it is long (minute candles, say)."""
    series = candles.filter(F.col("coin") == coin)
    if interval is not None and "interval" in candles.columns:
        series = series.filter(F.col("interval") == interval)
    closes = series.groupBy("coin", "time_ms").agg(F.max_by("close", "snapshot_at").alias("close"))
    grid = ends.select(F.lit(coin).alias("coin"), "end_ms").distinct()
    snapped = asof(grid, closes, ["coin"], "end_ms", "time_ms", ["close"], {"backward": "at_"}, rows_per_bucket=rows)
    steps = previous(snapped.select("coin", "end_ms", "at_close"), ["coin"], ["end_ms"], {"before": F.col("at_close")}, rows)
    return steps.select("end_ms", (ratio(F.col("at_close"), F.col("before")) - 1).alias("btc_ret"))


def daily_pnl_returns(equity: DataFrame, users: DataFrame | None = None, min_prev: float = 100.0) -> DataFrame:
    """Daily PnL returns from the `month` history: change of the day's last pnl / yesterday's value."""
    month = equity.filter(F.col("period") == "month")
    if users is not None:
        month = month.join(users.select("user").distinct(), "user", "left_semi")
    daily = last_in_bucket(month, ["user"], "time_ms", ["account_value", "pnl"], bucket_name="day_ms")
    w = Window.partitionBy("user").orderBy("day_ms")
    prev, dpnl = F.lag("account_value").over(w), F.col("pnl") - F.lag("pnl").over(w)
    return (daily.select("user", "day_ms", prev.alias("prev"), dpnl.alias("dpnl"))
            .filter((F.col("prev") > min_prev) & F.col("dpnl").isNotNull())
            .select("user", "day_ms", ratio(F.col("dpnl"), F.col("prev")).alias("ret")))


def calendar(returns: DataFrame) -> DataFrame:
    """One row: first_ms, last_ms and step_ms of the distinct step ends (a calendar-sized set)."""
    ends = returns.agg(F.sort_array(F.collect_set("end_ms")).alias("e"))
    gaps = F.zip_with(F.slice("e", 2, F.greatest(F.size("e") - 1, F.lit(0))), F.slice("e", 1, F.greatest(F.size("e") - 1, F.lit(0))),
                      lambda b, a: b - a)
    return ends.filter(F.size("e") > 0).select(F.element_at("e", 1).alias("first_ms"), F.element_at("e", -1).alias("last_ms"),
                                              F.array_min(gaps).alias("step_ms"))


def infer_step(returns: DataFrame) -> DataFrame:
    """The grid step: smallest difference between distinct step ends."""
    return calendar(returns).select("step_ms")


def steps_in(returns: DataFrame, start_ms: int | Column, end_ms: int | Column) -> DataFrame:
    """Steps ending in (start, end]."""
    return returns.filter((F.col("end_ms") > start_ms) & (F.col("end_ms") <= end_ms))
