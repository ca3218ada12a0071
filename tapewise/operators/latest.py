"""Deduplication and latest-value operators.

All but the two deduplications are partially aggregated groupBys: copies of a row are combined before
the shuffle, so a key with very many copies costs one row per map task. The deduplications meet rows
that have a copy or two, which are rarely in one map task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import DAY_MS, col

EQUITY_KEY = ("user", "period", "time_ms")
FILL_KEY = ("user", "tid", "oid")
DEALS = 16      # tasks that a user's fills are dealt out to


def keep_one(df: DataFrame, keys: Sequence[str], order: Column | None = None, last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by `order`; without an order the smallest row, so that
    the choice among differing copies does not depend on partitioning."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    if order is None:
        chosen = F.min(row)
    else:
        ranked = F.struct(order.alias("_o"), *rest)
        chosen = F.max(ranked) if last else F.min(ranked)
    return df.groupBy(*keys).agg(chosen.alias("_r")).select(
        *[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def _first_copies(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`keep_one` of rows that are nearly all different: the smallest of whole rows is found by sorting, and before the
    shuffle that would sort (and spill) a whole map task for next to no copies. Rows that are dealt out by some of the
    keys already, say by user, stay where they are."""
    copies = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") == 1).drop("_copy")


def dedup_equity(equity: DataFrame) -> DataFrame:
    """One row per (user, period, time_ms)."""
    return _first_copies(equity, EQUITY_KEY, [c for c in equity.columns if c not in EQUITY_KEY])


def dedup_fills(fills: DataFrame, since_ms: int | None = None, whole_users: bool = False, parts: int | None = None) -> DataFrame:
    """One row per (user, tid, oid): fetches overlap. The rows are sorted by numbers first, which is cheaper than by texts.

    With `whole_users`, for fills of which no user has too many for one task, a user's rows go to one task (of `parts`), and what
    follows per user needs no further shuffle.

    With `since_ms`, an earlier fill keeps its time, coin and direction and what comes before them in a row; the other
    columns become null, so that they are not shuffled. The choice among copies stays the same: later columns decide only
    between copies that agree in the time."""
    if since_ms is not None:
        rest = [c for c in fills.columns if c not in FILL_KEY]
        kept = {*FILL_KEY, *rest[:1 + max(rest.index(c) for c in ("time_ms", "coin", "dir"))]}
        fills = fills.select(*[F.col(c) if c in kept else F.when(F.col("time_ms") >= since_ms, F.col(c)).alias(c) for c in fills.columns])
    rest = [c for c in fills.columns if c not in FILL_KEY]
    if whole_users:
        return _first_copies(fills.repartition(*([parts] if parts else []), "user"), ["tid", "oid", "user"], rest)
    # A user's rows go to a few tasks: not to one, since a user may own a third of them, and not to all, so that what is
    # counted per user later is combined before it is shuffled. Neighbouring ids stay together: they resemble each other.
    dealt = fills.withColumn("_deal", F.pmod(F.xxhash64(F.shiftright("tid", 6), "oid"), F.lit(DEALS)))
    return _first_copies(dealt.repartition("user", "_deal"), ["tid", "oid", "user", "_deal"], rest).drop("_deal")


def latest_by_snapshot(df: DataFrame, keys: Sequence[str], snapshot: str = "snapshot_at") -> DataFrame:
    """The row of the newest snapshot per key."""
    return keep_one(df, keys, F.col(snapshot), last=True)


def latest_value(df: DataFrame, keys: Sequence[str], value: str, at: str, name: str | None = None) -> DataFrame:
    """The last value in time order per key."""
    return df.groupBy(*keys).agg(F.max_by(value, at).alias(name or value))


def newest_snapshot(df: DataFrame, stamp: Column | str) -> DataFrame:
    """Rows of the globally newest snapshot; the newest stamp is a scalar subquery."""
    stamped = df.withColumn("_stamp", col(stamp))
    newest = stamped.agg(F.max("_stamp").alias("m")).scalar()
    return stamped.filter(F.col("_stamp") == newest).drop("_stamp")


def snapshot_versions(leaderboard: DataFrame, data_as_of: str = "data_as_of_ms",
                      snapshot_at: str = "snapshot_ms") -> DataFrame:
    """Leaderboard rows dated by when the source produced them (else when they were fetched), the
    same version once per user: the earliest fetch is kept."""
    dated = leaderboard.withColumn("snap_ms", F.coalesce(F.col(data_as_of), F.col(snapshot_at)))
    return keep_one(dated, ["snap_ms", "user"], F.col(snapshot_at))


def last_in_bucket(df: DataFrame, keys: Sequence[str], at: str, values: Sequence[str],
                   bucket: Column | None = None, bucket_name: str = "bucket_ms",
                   bucket_width_ms: int = DAY_MS) -> DataFrame:
    """The last values per (key, time bucket); the default bucket is `bucket_width_ms` wide."""
    start = bucket if bucket is not None else F.floor(F.col(at) / bucket_width_ms).cast("long") * bucket_width_ms
    # One winner row per bucket, so the values always come from the same observation.
    return (df.groupBy(*keys, start.alias(bucket_name))
            .agg(F.max(F.struct(F.col(at), *values)).alias("_r"))
            .select(*keys, bucket_name, F.col(f"_r.{at}").alias(at),
                    *[F.col(f"_r.{v}").alias(v) for v in values]))
