"""The composite score, behavior penalties and exclusions, and the selectors built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import finite, hash_order
from ..functions.ranks import ranked, top_n

# Component weights, flat penalties, exclusion limits, eligibility limits.
WEIGHTS = {"sharpe": 0.25, "low_dd": 0.20, "consistency": 0.20, "n_obs": 0.15, "stability": 0.10}
PENALTIES = (("liquidations", 0.0, 15.0), ("martingale_share", 0.6, 10.0),
             ("p95_leverage", 15.0, 10.0), ("top_coin_share", 0.85, 5.0))
EXCLUSIONS = (("liquidations", 0.0), ("martingale_share", 0.6), ("p95_leverage", 15.0))
MAX_STEP_ABS_RET = 1.0
MIN_STEP_VOL = 0.002


def score_from_signals(signals: DataFrame, behavior: DataFrame | None = None,
                       keys: Sequence[str] = ("formation_ms",)) -> DataFrame:
    """Adds trader_score: 100 x weighted percentile of the components within the eligible pool of the
    same formation, less behavior penalties; null for ineligible rows. A missing component counts 0.

    The five components are ranked in one pass over (formation, component, value)."""
    keys = list(keys)
    eligible = F.col("max_abs_ret") <= MAX_STEP_ABS_RET
    parts = F.array(*[F.struct(F.lit(c).alias("component"), F.lit(w).alias("weight"),
                               F.when(eligible & finite(c), F.col(c).cast("double")).alias("value"))
                      for c, w in WEIGHTS.items()])
    long = signals.select(*keys, "user", F.explode(parts).alias("p")).select(
        *keys, "user", "p.component", "p.weight", "p.value").filter(F.col("value").isNotNull())
    pct = ranked(long, [*keys, "component"], "value", extra=("n",))
    base = pct.groupBy(*keys, "user").agg(
        (F.sum(F.col("rank") / F.col("n") * F.col("weight")) / sum(WEIGHTS.values())).alias("_base"))
    scored = (signals.join(base, [*keys, "user"], "left")
              .withColumn("trader_score", F.when(eligible, 100 * F.coalesce("_base", F.lit(0.0)))).drop("_base"))
    return behavior_penalties(scored, behavior)


def behavior_penalties(scored: DataFrame, behavior: DataFrame | None) -> DataFrame:
    """Flat deductions where fills are known; an unknown feature costs nothing. Floor 0."""
    if behavior is None:
        return scored.withColumn("behavior_known", F.lit(False)).withColumn("behavior_penalty", F.lit(0.0))
    rules = [r for r in PENALTIES if r[0] in behavior.columns]
    facts = behavior.select("user", *[F.col(c).alias(f"_b_{c}") for c, _, _ in rules])
    hit = [F.when(F.coalesce(F.col(f"_b_{c}") > limit, F.lit(False)), points).otherwise(0.0) for c, limit, points in rules]
    known = F.col("_b_liquidations").isNotNull() if "liquidations" in behavior.columns else F.lit(False)
    out = scored.join(facts, "user", "left").withColumn("behavior_known", known)
    out = out.withColumn("behavior_penalty", sum(hit, F.lit(0.0)))
    # An ineligible row keeps its null score.
    cut = F.greatest(F.col("trader_score") - F.col("behavior_penalty"), F.lit(0.0))
    return (out.withColumn("trader_score", F.when(F.col("trader_score").isNotNull(), cut))
            .drop(*[f"_b_{c}" for c, _, _ in rules]))


def behavior_exclusions(signals: DataFrame, behavior: DataFrame | None) -> DataFrame:
    """Adds exclusion_reason (first rule that matches) and behavior_excluded; unknown is not excluded."""
    if behavior is None:
        return (signals.withColumn("exclusion_reason", F.lit(None).cast("string"))
                .withColumn("behavior_excluded", F.lit(False)))
    rules = [r for r in EXCLUSIONS if r[0] in behavior.columns]
    facts = behavior.select("user", *[F.col(c).alias(f"_x_{c}") for c, _ in rules])
    reason = F.coalesce(*[F.when(F.col(f"_x_{c}") > limit, F.lit(c)) for c, limit in rules],
                        F.lit(None).cast("string"))
    return (signals.join(facts, "user", "left").withColumn("exclusion_reason", reason)
            .withColumn("behavior_excluded", F.col("exclusion_reason").isNotNull())
            .drop(*[f"_x_{c}" for c, _ in rules]))


# --- selectors: signals -> (formation_ms, user, rank) ----------------------------------------------

def _picked(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, "user", "rank")


def top_by(signals: DataFrame, signal: str, n: int, require_positive: bool = False,
           keys: Sequence[str] = ("formation_ms",)) -> DataFrame:
    """The n highest finite signals per formation, ties by user."""
    pool = signals.filter(finite(signal))
    if require_positive:
        pool = pool.filter(F.col("ret") > 0)
    return _picked(top_n(pool, keys, [F.col(signal).desc(), F.col("user").asc()], n), keys)


def random_pick(signals: DataFrame, n: int, seed: Column | int = 0, keys: Sequence[str] = ("formation_ms",),
                draw: Sequence[str] = ("formation_ms",)) -> DataFrame:
    """n users per formation in a seeded hash order."""
    s = seed if isinstance(seed, Column) else F.lit(seed)
    pool = signals.withColumn("_h", hash_order(F.col("user"), s, *[F.col(c) for c in draw]))
    return _picked(top_n(pool, keys, [F.col("_h").asc(), F.col("user").asc()], n), keys)


def everyone(signals: DataFrame, keys: Sequence[str] = ("formation_ms",)) -> DataFrame:
    """The whole pool."""
    return signals.select(*keys, "user", F.lit(None).cast("int").alias("rank"))


def top_by_score(signals: DataFrame, n: int, behavior: DataFrame | None = None,
                 keys: Sequence[str] = ("formation_ms",)) -> DataFrame:
    """The n highest scores per formation."""
    return top_by(score_from_signals(signals, behavior, keys), "trader_score", n, keys=keys)


def top_by_sharpe_v2(signals: DataFrame, n: int, behavior: DataFrame | None = None,
                     keys: Sequence[str] = ("formation_ms",)) -> DataFrame:
    """The n highest Sharpe ratios among eligible, active accounts without a behavior exclusion."""
    pool = behavior_exclusions(signals, behavior).filter(
        ~F.col("behavior_excluded") & (F.col("max_abs_ret") <= MAX_STEP_ABS_RET) & (F.col("vol") >= MIN_STEP_VOL))
    return top_by(pool, "sharpe", n, keys=keys)
