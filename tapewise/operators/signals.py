"""Signals at formation dates, forward outcomes and persistence statistics.

All formation dates are evaluated in one job: every step is expanded to the formations whose window
contains it by integer arithmetic, so there is no loop over dates and no range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import DAY_MS, HOUR_MS, WEEK_MS, finite, hash_uniform, int_div, ratio
from ..functions.ranks import exact_quantiles, ranked, text_position
from ..session import forget, shared
from .latest import snapshot_versions
from .returns import benchmark_step_returns, calendar

SIGNALS = ("ret", "sharpe", "low_dd", "pnl_usd", "random")
QUINTILE = 0.2
MIN_CROSS_SECTION = 10


# --- formation dates ------------------------------------------------------------------------------

def formation_dates(returns: DataFrame, lookback_weeks: int = 12, hold_weeks: int = 4) -> DataFrame:
    """One row per formation date: formation_ms, k (0, 1, ...). Dates step by the holding period, from
    the first step end plus the lookback until the last step end minus the holding period."""
    cal = calendar(returns)
    first = F.col("first_ms") + lookback_weeks * WEEK_MS
    last = F.col("last_ms") - hold_weeks * WEEK_MS
    return (cal.select(first.alias("a"), last.alias("b")).filter(F.col("a") <= F.col("b"))
            .select(F.posexplode(F.sequence("a", "b", F.lit(hold_weeks * WEEK_MS))).alias("k", "formation_ms")))


def _calendar_columns(returns: DataFrame) -> Column:
    cal = calendar(returns)
    return cal.select(F.struct("first_ms", "last_ms", "step_ms").alias("c")).scalar()


def expand_lookback(returns: DataFrame, lookback_weeks: int = 12, hold_weeks: int = 4) -> DataFrame:
    """Each step once per formation whose lookback window (at - lookback, at] contains its end.

    Adds formation_ms and step_ms. The steps are dealt out by user before they are repeated, so what follows by (formation,
    user) shuffles no repeats; a user has at most one step per step of the calendar."""
    hold, look = hold_weeks * WEEK_MS, lookback_weeks * WEEK_MS
    rows = returns.repartition("user").withColumn("_c", _calendar_columns(returns))
    offset = F.col("end_ms") - (F.col("_c.first_ms") + look)
    last_k = int_div(F.col("_c.last_ms") - hold - F.col("_c.first_ms") - look, hold)
    lo = F.greatest(F.lit(0), F.ceil(offset / hold)).cast("long")
    hi = F.least((F.ceil((offset + look) / hold) - 1).cast("long"), last_k)
    return (rows.withColumn("_lo", lo).withColumn("_hi", hi).filter(F.col("_lo") <= F.col("_hi"))
            .withColumn("_k", F.explode(F.sequence("_lo", "_hi")))
            .withColumn("formation_ms", F.col("_c.first_ms") + look + F.col("_k") * hold)
            .withColumn("step_ms", F.col("_c.step_ms")).drop("_c", "_lo", "_hi", "_k"))


def expand_holding(returns: DataFrame, lookback_weeks: int = 12, hold_weeks: int = 4) -> DataFrame:
    """Each step with the one formation whose holding window (at, at + hold] contains its end."""
    hold, look = hold_weeks * WEEK_MS, lookback_weeks * WEEK_MS
    rows = returns.withColumn("_c", _calendar_columns(returns))
    first = F.col("_c.first_ms") + look
    k = (F.ceil((F.col("end_ms") - first) / hold) - 1).cast("long")
    last_k = int_div(F.col("_c.last_ms") - hold - first, hold)
    return (rows.withColumn("_k", k).filter((F.col("_k") >= 0) & (F.col("_k") <= last_k))
            .withColumn("formation_ms", first + F.col("_k") * hold)
            .withColumn("step_ms", F.col("_c.step_ms")).drop("_c", "_k"))


def min_steps(step_ms: Column, weeks: int, frac: float, least: int) -> Column:
    """How many steps a window must have: the given share of it, at least `least`."""
    return F.greatest(F.lit(least), F.floor(weeks * (F.lit(WEEK_MS) / step_ms) * frac).cast("int"))


# --- signals and outcomes -------------------------------------------------------------------------

def signals_of(steps: DataFrame, seed: int | str = 0, carried: Sequence[str] = ()) -> DataFrame:
    """Signals per (formation_ms, user) from rows of steps (formation_ms, user, end_ms, ret, dpnl) and the `carried` columns,
    which have one value per (formation_ms, user).

    The windows run over the steps of one lookback, a handful of rows. Ratios with a zero
    denominator are null (they count as missing wherever signals are ranked)."""
    w = Window.partitionBy("formation_ms", "user").orderBy("end_ms")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = steps.filter(F.col("ret").isNotNull()).select(
        "*", F.product(1 + F.col("ret")).over(upto).alias("_curve"), F.row_number().over(w).alias("_rn"),
        F.count(F.lit(1)).over(Window.partitionBy("formation_ms", "user")).alias("_n"))
    rows = rows.withColumn("_dd", ratio(F.col("_curve"), F.max("_curve").over(upto)) - 1)
    ret, half = F.col("ret"), int_div(F.col("_n"), 2)
    gain, loss = F.greatest(ret, F.lit(0.0)), F.least(ret, F.lit(0.0))
    total = F.product(1 + ret) - 1
    out = rows.groupBy("formation_ms", "user").agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.max(F.abs(ret)).alias("max_abs_ret"),
        total.alias("ret"),
        ratio(F.avg(ret), F.stddev_samp(ret)).alias("sharpe"),
        F.stddev_samp(ret).alias("vol"),
        F.min("_dd").alias("low_dd"),
        F.sum("dpnl").alias("pnl_usd"),
        F.avg(F.when(ret > 0, 1.0).otherwise(0.0)).alias("consistency"),
        ratio(F.avg(ret), F.sqrt(F.avg(loss * loss))).alias("sortino"),
        F.when(F.min("_dd") < 0, total / -F.min("_dd")).alias("calmar"),
        F.when(F.sum(loss) < 0, F.sum(gain) / -F.sum(loss)).alias("profit_factor"),
        (-F.abs(F.avg(F.when(F.col("_rn") <= half, ret)) - F.avg(F.when(F.col("_rn") > half, ret)))).alias("stability"),
        *[F.max(c).alias(c) for c in carried])
    return out.withColumn("random", hash_uniform(F.col("user"), F.lit(seed), F.col("formation_ms")))


def formation_signals(returns: DataFrame, lookback_weeks: int = 12, hold_weeks: int = 4,
                      min_obs: int | None = None, min_obs_frac: float = 0.75, seed: int | str = 0, last: Sequence[str] = ()) -> DataFrame:
    """Signals of every user at every formation date, from steps ending at or before it only. The columns in `last` are
    added as they are in the user's last step of the lookback, whether that has a return or not."""
    steps = expand_lookback(returns.select("user", "end_ms", "ret", "dpnl", *last), lookback_weeks, hold_weeks)
    whole = Window.partitionBy("formation_ms", "user")
    steps = steps.withColumns({c: F.max_by(c, "end_ms").over(whole) for c in last}) if last else steps
    if min_obs is not None:
        return signals_of(steps, seed, last).filter(F.col("n_obs") >= min_obs)
    # The threshold follows from the data's own grid, so it travels with the rows.
    need = min_steps(F.col("step_ms"), lookback_weeks, min_obs_frac, 2)
    enough = (steps.withColumn("_need", need)
              .withColumn("_have", F.count("ret").over(whole)).filter(F.col("_have") >= F.col("_need")))
    return signals_of(enough.drop("_need", "_have", "step_ms"), seed, last)


def signals_at(returns: DataFrame, at_ms: int | Column, lookback_weeks: int = 12, min_obs: int = 4,
               seed: int | str = 0) -> DataFrame:
    """Signals at one date (a literal or a scalar subquery)."""
    at = F.lit(at_ms) if isinstance(at_ms, int) else at_ms
    rows = returns.withColumn("formation_ms", at).filter(
        (F.col("end_ms") > F.col("formation_ms") - lookback_weeks * WEEK_MS) & (F.col("end_ms") <= F.col("formation_ms")))
    return signals_of(rows, seed).filter(F.col("n_obs") >= min_obs)


def forward_outcome(returns: DataFrame, lookback_weeks: int = 12, hold_weeks: int = 4,
                    min_obs_frac: float = 0.75) -> DataFrame:
    """Compound return of every user over the holding window of every formation date."""
    steps = expand_holding(returns, lookback_weeks, hold_weeks).filter(F.col("ret").isNotNull())
    out = steps.groupBy("formation_ms", "user").agg(
        F.count(F.lit(1)).alias("fwd_obs"), (F.product(1 + F.col("ret")) - 1).alias("fwd_ret"),
        F.max("step_ms").alias("_step"))
    return out.filter(F.col("fwd_obs") >= min_steps(F.col("_step"), hold_weeks, min_obs_frac, 1)).drop("_step")


# --- statistics of one cross-section per group -----------------------------------------------------

def rank_stats(df: DataFrame, keys: Sequence[str], signal: str, outcome: str, entity: str = "user") -> DataFrame:
    """How well `signal` ranks `outcome` within each group.

    n; ic = rank correlation; top / bottom / all = median outcome of the top and bottom fifth by signal
    and of everyone; top_hit = share of the top fifth above the overall median. Only n below ten rows.
    Ranks, positions and medians are computed over value buckets, so a cross-section of any size is
    spread over tasks; ties in the signal are ordered by entity."""
    keys = list(keys)
    both = shared(df.filter(finite(signal) & finite(outcome)).select(
        *keys, F.col(entity).alias("entity"), F.col(signal).cast("double").alias("sig"),
        F.col(outcome).cast("double").alias("out")))
    r = ranked(both, keys, "sig", rank="sig_rank", extra=("n", "above", "below", "ties"))
    r = shared(ranked(r, keys, "out", rank="out_rank", counted=both))      # the rows of r, before they were joined
    forget(both)
    ic = r.groupBy(*keys).agg(
        F.max("n").alias("n"),
        ratio(F.covar_samp("sig_rank", "out_rank"), F.stddev_samp("sig_rank") * F.stddev_samp("out_rank")).alias("ic"))
    # Membership of the top and bottom k; only ties across a cut need the entity order.
    k = F.greatest(F.lit(1), F.floor(F.col("n") * QUINTILE)).cast("long")
    r = r.filter(F.col("n") >= MIN_CROSS_SECTION).withColumn("k", k)
    first, last = F.col("above") + 1, F.col("above") + F.col("ties")
    cut_top = (first <= F.col("k")) & (last > F.col("k"))
    cut_bottom = (first <= F.col("n") - F.col("k")) & (last > F.col("n") - F.col("k"))
    clear = r.filter(~(cut_top | cut_bottom)).withColumn("pos", first)
    tied = text_position(r.filter(cut_top | cut_bottom), [*keys, "sig"], "entity", "_p").withColumn(
        "pos", F.col("above") + F.col("_p")).drop("_p")
    placed = shared(clear.unionByName(tied).select(
        *keys, "out", F.when(F.col("pos") <= F.col("k"), "top")
        .when(F.col("pos") > F.col("n") - F.col("k"), "bottom").otherwise("middle").alias("part")))
    members = placed.select(*keys, "out", F.explode(
        F.when(F.col("part") == "middle", F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.col("part")))).alias("grp"))
    med = exact_quantiles(members, [*keys, "grp"], "out")
    med = med.groupBy(*keys).agg(*[F.max(F.when(F.col("grp") == g, F.col("median"))).alias(g) for g in ("top", "bottom", "all")])
    hits = (placed.filter(F.col("part") == "top").join(med.select(*keys, "all"), keys)
            .groupBy(*keys).agg(F.avg(F.when(F.col("out") > F.col("all"), 1.0).otherwise(0.0)).alias("top_hit")))
    small = F.col("n") < MIN_CROSS_SECTION
    return (ic.withColumn("ic", F.when(~small, F.col("ic"))).join(med, keys, "left").join(hits, keys, "left"))


def persistence(signals: DataFrame, outcomes: DataFrame, names: Sequence[str] = SIGNALS) -> DataFrame:
    """rank_stats per (formation_ms, signal) for the named signal columns."""
    joined = signals.join(outcomes, ["formation_ms", "user"])
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("value")) for s in names]))
    long = joined.select("formation_ms", "user", "fwd_ret", pairs.alias("p")).select(
        "formation_ms", "user", "fwd_ret", "p.signal", "p.value")
    return rank_stats(long, ["formation_ms", "signal"], "value", "fwd_ret")


def retroactive_persistence(returns: DataFrame, lookback_weeks: int = 12, hold_weeks: int = 4,
                            min_obs_frac: float = 0.75, users: DataFrame | None = None,
                            names: Sequence[str] = SIGNALS) -> DataFrame:
    """One row per (formation date, signal) over non-overlapping holding windows."""
    if users is not None:
        returns = returns.join(users.select("user").distinct(), "user", "left_semi")
    returns = shared(returns)
    sig = formation_signals(returns, lookback_weeks, hold_weeks, min_obs_frac=min_obs_frac)
    out = forward_outcome(returns, lookback_weeks, hold_weeks, min_obs_frac)
    return persistence(sig, out, names)


def snapshot_pairs(leaderboard: DataFrame, horizon_days: int = 7, slack_ms: int = 12 * HOUR_MS) -> DataFrame:
    """Each snapshot with the later one nearest to `horizon_days` after it, within the slack.

    An equi-join on slack-wide buckets: the target and its two neighbours hold every candidate."""
    snaps = leaderboard.select("snap_ms").distinct()
    cell = max(int(slack_ms), 1)
    target = F.col("a") + horizon_days * DAY_MS
    a = (snaps.select(F.col("snap_ms").alias("a")).withColumn("t", target)
         .withColumn("cell", F.explode(F.sequence(int_div(F.col("t"), cell) - 1, int_div(F.col("t"), cell) + 1))))
    b = snaps.select(F.col("snap_ms").alias("b"), int_div(F.col("snap_ms"), cell).alias("cell"))
    gap = F.abs(F.col("b") - F.col("t"))
    return (a.join(b, "cell").filter((gap <= slack_ms) & (F.col("b") > F.col("a")))
            .groupBy(F.col("a").alias("snapshot_a_ms"))
            .agg(F.min(F.struct(gap.alias("g"), F.col("b"))).alias("m"))
            .select("snapshot_a_ms", F.col("m.b").alias("snapshot_b_ms")))


def leaderboard_persistence(leaderboard: DataFrame, horizon_days: int = 7, period: str = "week",
                            min_account: float = 10_000.0, exclude: DataFrame | None = None,
                            slack_ms: int = 12 * HOUR_MS) -> DataFrame:
    """Forward test: a snapshot's ROI against the same users' ROI one horizon later.

    `dropped` counts users without an outcome: leaving them out silently would be survivorship bias."""
    roi = f"{period}_roi"
    lb = snapshot_versions(leaderboard).select("snap_ms", "user", "account_value", F.col(roi).alias("roi"))
    if exclude is not None:
        lb = lb.join(exclude.select("user").distinct(), "user", "left_anti")
    lb = shared(lb)
    pairs = snapshot_pairs(lb, horizon_days, slack_ms)
    # At most one pair per snapshot: joining it only dates the rows.
    a = (lb.filter(F.col("account_value") >= min_account)
         .join(pairs, lb["snap_ms"] == pairs["snapshot_a_ms"])
         .select("snapshot_a_ms", "snapshot_b_ms", "user", F.col("roi").alias("value")))
    b = lb.select(F.col("snap_ms").alias("snapshot_b_ms"), "user", F.col("roi").alias("outcome"))
    joined = a.join(b, ["snapshot_b_ms", "user"], "left").withColumn(
        "random", hash_uniform(F.col("user"), F.lit("lb"), F.col("snapshot_a_ms")))
    keys = ["snapshot_a_ms", "snapshot_b_ms"]
    long = joined.select(*keys, "user", "outcome", F.explode(F.array(
        F.struct(F.lit(roi).alias("signal"), F.col("value").alias("v")),
        F.struct(F.lit("random").alias("signal"), F.col("random").alias("v")))).alias("p")).select(
        *keys, "user", "outcome", "p.signal", "p.v")
    counts = long.groupBy(*keys, "signal").agg(F.count_if(F.col("outcome").isNull()).alias("dropped"))
    stats = rank_stats(long, [*keys, "signal"], "v", "outcome")
    return (counts.join(stats, [*keys, "signal"], "left")
            .withColumn("n", F.coalesce(F.col("n"), F.lit(0).cast("long"))))


def summarize(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per signal over formation dates: mean IC, its t-statistic, share of positive periods, spreads."""
    ic = F.col("ic")
    return table.filter(ic.isNotNull()).groupBy(*keys, "signal").agg(
        F.count(F.lit(1)).alias("periods"), F.bround(F.avg("n"), 0).alias("wallets_avg"),
        F.avg(ic).alias("mean_ic"),
        ratio(F.avg(ic), F.stddev_samp(ic) / F.sqrt(F.count(F.lit(1)))).alias("ic_tstat"),
        F.avg(F.when(ic > 0, 1.0).otherwise(0.0)).alias("ic_positive"),
        F.avg(F.col("top") - F.col("all")).alias("top_minus_all"),
        F.avg(F.col("top") - F.col("bottom")).alias("top_minus_bottom"),
        F.avg("top_hit").alias("top_hit"))


def independent_periods(table: DataFrame, at: str = "snapshot_a_ms", every_days: int = 7) -> DataFrame:
    """Rows whose day lies a multiple of `every_days` after the first: non-overlapping windows."""
    first = table.agg(F.min(at).alias("m")).scalar()
    day = lambda c: int_div(c, DAY_MS)
    return table.filter((day(F.col(at)) - day(first)) % every_days == 0)


def forward_test(table: DataFrame, signal: str = "week_roi") -> DataFrame:
    """The forward test in one row per view (all pairs, independent weeks, random control), with the
    first day, mean cross-section and median number of dropped users of the whole table."""
    views = table.filter(F.col("signal").isin(signal, "random")).withColumn(
        "view", F.when(F.col("signal") == "random", "random").otherwise("all_pairs"))
    alone = independent_periods(table).filter(F.col("signal") == signal).withColumn("view", F.lit("independent"))
    s = summarize(views.unionByName(alone), ["view"])
    # One value per snapshot pair: a calendar-sized set, so an exact median in one aggregate is safe.
    head = table.agg(F.min("snapshot_a_ms").alias("f"), F.avg("n").alias("w"), F.median("dropped").alias("d"))
    head = head.select(F.struct("f", "w", "d").alias("h")).scalar()
    return s.withColumn("_h", head).select(
        "view", "periods", "mean_ic", "ic_tstat", "ic_positive", F.col("_h.f").alias("first_ms"),
        F.col("_h.w").alias("wallets"), F.col("_h.d").alias("dropped_median"))


def trader_beta(returns: DataFrame, candles: DataFrame, coin: str = "BTC", min_obs: int = 6) -> DataFrame:
    """Beta, alpha per step and correlation of each user's step returns with the benchmark's."""
    bench = benchmark_step_returns(candles, returns, coin)
    rows = returns.join(bench, "end_ms").filter(F.col("ret").isNotNull() & F.col("btc_ret").isNotNull())
    beta = ratio(F.covar_samp("ret", "btc_ret"), F.var_samp("btc_ret"))
    out = rows.groupBy("user").agg(
        F.count(F.lit(1)).alias("n_beta_obs"), beta.alias("beta"),
        ratio(F.covar_samp("ret", "btc_ret"), F.stddev_samp("ret") * F.stddev_samp("btc_ret")).alias("btc_corr"),
        F.avg("ret").alias("_mr"), F.avg("btc_ret").alias("_mb"))
    return (out.filter(F.col("n_beta_obs") >= min_obs)
            .withColumn("alpha", F.col("_mr") - F.col("beta") * F.col("_mb")).drop("_mr", "_mb"))


def ic_error_band(summary: DataFrame) -> DataFrame:
    """Mean IC with two standard errors either side (standard error = |mean / t|)."""
    se = F.abs(ratio(F.col("mean_ic"), F.col("ic_tstat")))
    return summary.select("signal", "mean_ic", se.alias("se"), (F.col("mean_ic") - 2 * se).alias("low"),
                          (F.col("mean_ic") + 2 * se).alias("high"))
