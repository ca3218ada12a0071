"""Ordered scans that never put a hot entity into one task.

A plain window over `partitionBy(entity)` sorts everything an entity owns in one task, and one
entity may own a third of the table. Entities with more than ROWS_PER_BUCKET rows are therefore cut
into buckets of about that many rows: cuts lie between rows in their full order, so neither a burst
nor many rows of one instant end up in one bucket. Each bucket is summarized with a partially
aggregated groupBy, the summaries (one small row per bucket) are scanned per entity, and the state
before each bucket enters the bucket as one *seed row*. Ordinary window functions then run per
(entity, bucket). All other entities take a plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared

BUCKET = "_bucket"
ROWS_PER_BUCKET = 1_000_000
SEED = "_seed"      # 0 = seed row, 1 = ordinary row: seeds sort first

Combine = Callable[[Column], Column]


def split_hot(df: DataFrame, by: Sequence[str], order: Sequence[str], rows: int = ROWS_PER_BUCKET,
              counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary entities, rows of entities with more than `rows` rows with `_bucket`, or None).

    Buckets number the slices of a range sort by (by, order, hash of the row): increasing in `order` within an
    entity, and balanced by rows whatever the distribution of the order columns, ties included. The sorted
    slices are written once, so a bucket means the same rows wherever the result is read. The list of hot
    entities has at most (table rows / `rows`) entries; Spark decides by its size how to join it. `counted` may be another
    frame with as many rows per entity (or a few more) that is cheaper to count; a row with a `_rows` column stands for so many."""
    by = list(by)
    counted = df if counted is None else counted
    n = F.sum("_rows") if "_rows" in counted.columns else F.count(F.lit(1))
    hot = shared(counted.groupBy(*by).agg(n.alias("_n")).filter(F.col("_n") > rows))
    found = hot.agg(F.sum("_n")).first()[0]
    if not found:
        return df, None
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(hot[k]) for k in by])
    # Twice as many slices as needed: the sort's cuts come from a sample.
    slices = 2 * -(-found // rows)
    owned = df.join(hot.select(*by), same, "left_semi").withColumn("_tie", F.xxhash64(*df.columns))
    sliced = owned.repartitionByRange(slices, *by, *order, "_tie").withColumn(BUCKET, F.spark_partition_id().cast("long")).drop("_tie")
    return df.join(hot.select(*by), same, "left_anti"), shared(sliced)


def last_value(c: Column) -> Column:
    return F.last(c, ignorenulls=True)


def seeded(df: DataFrame, keys: Sequence[str], state: dict[str, tuple[Column, Combine]]) -> DataFrame:
    """`df` (with `_bucket`) plus one seed row per (keys, bucket) carrying the state before that bucket.

    state: column name -> (aggregate of one bucket, how the aggregates of earlier buckets combine).
    Adds `_seed` and the state columns (null on ordinary rows)."""
    per = df.groupBy(*keys, BUCKET).agg(*[agg.alias(name) for name, (agg, _) in state.items()])
    before = (Window.partitionBy(*keys).orderBy(BUCKET)
              .rowsBetween(Window.unboundedPreceding, -1))
    seeds = per.select(*keys, BUCKET, F.lit(0).alias(SEED),
                       *[combine(F.col(name)).over(before).alias(name) for name, (_, combine) in state.items()])
    # An entity's first bucket has no state before it.
    has_state = reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in state])
    return (df.withColumn(SEED, F.lit(1))
            .unionByName(seeds.filter(has_state), allowMissingColumns=True))


def in_bucket(keys: Sequence[str], *order: Column | str):
    """Window specification of the rows of one bucket in order, seed first."""
    return Window.partitionBy(*keys, BUCKET).orderBy(SEED, *order)


def drop_seeds(df: DataFrame, *extra: str) -> DataFrame:
    return df.filter(F.col(SEED) == 1).drop(BUCKET, SEED, *extra)


def _running(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], fold: Callable,
             rows: int) -> DataFrame:
    work = df.select("*", *[v.alias(f"_v_{n}") for n, v in values.items()])
    cold, hot = split_hot(work, keys, order, rows)
    plain = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cold.select(*df.columns, *[fold(F.col(f"_v_{n}")).over(plain).alias(n) for n in values])
    if hot is None:
        return out
    state = {f"_s_{n}": (fold(F.col(f"_v_{n}")), fold) for n in values}
    work = seeded(hot, keys, state)
    w = in_bucket(keys, *order).rowsBetween(Window.unboundedPreceding, 0)
    work = work.select("*", *[fold(F.coalesce(F.col(f"_v_{n}"), F.col(f"_s_{n}"))).over(w).alias(n) for n in values])
    return out.unionByName(drop_seeds(work, *[f"_v_{n}" for n in values], *state))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column],
                rows: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds inclusive running sums (name -> summed expression) in the given order."""
    return _running(df, keys, order, values, F.sum, rows)


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column],
                rows: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds inclusive running maxima (name -> expression) in the given order."""
    return _running(df, keys, order, values, F.max, rows)


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column],
             rows: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds values of the preceding row (name -> expression), null on an entity's first row.

    `order` must be columns that order the rows of an entity without ties."""
    work = df.withColumn("_now", F.struct(*[v.alias(n) for n, v in values.items()]))
    cold, hot = split_hot(work, keys, order, rows)
    out = cold.withColumn("_prev", F.lag("_now").over(Window.partitionBy(*keys).orderBy(*order))).drop("_now")
    if hot is not None:
        state = {"_before": (F.max_by("_now", F.struct(*order)), last_value)}
        lagged = F.lag(F.coalesce(F.col("_now"), F.col("_before"))).over(in_bucket(keys, *order))
        out = out.unionByName(drop_seeds(seeded(hot, keys, state).withColumn("_prev", lagged), "_now", "_before"))
    return out.select(*df.columns, *[F.col(f"_prev.{n}").alias(n) for n in values])


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str,
         values: Sequence[str], directions: dict[str, str], tolerance_ms: int | None = None,
         rows_per_bucket: int = ROWS_PER_BUCKET, counted: DataFrame | None = None) -> DataFrame:
    """Each left row with the nearest right row of the same entity, within the tolerance.

    directions: "backward" (at or before the left row) and/or "forward" (at or after it) -> prefix
    of the added columns: prefix + right_on and prefix + each value, null where nothing matches.
    The right side must be unique per (by, right_on). Both sides are shuffled once by entity; only
    entities with more than `rows_per_bucket` rows on both sides together are cut into buckets. `counted` (see `split_hot`)
    spares computing both sides once more to count them."""
    cold, hot = split_hot(timeline(left, right, by, left_on, right_on, values), by, TIMELINE_ORDER, rows_per_bucket, counted)
    return asof_timeline(cold, hot, by, directions, tolerance_ms)


# The order of a timeline: right rows come before left rows of the same instant, because it matches.
TIMELINE_ORDER = ("_t", "_side")


def timeline(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, values: Sequence[str]) -> DataFrame:
    """The rows of both sides of an as-of join in one frame, which can also be stored: by, `_t`, `_side` (0 = right),
    `_left` (the left row) and `_right` (`right_on`, then the values)."""
    lrows = left.select(*by, F.col(left_on).alias("_t"), F.struct(*left.columns).alias("_left"))
    rrows = right.filter(F.col(right_on).isNotNull()).select(
        *by, F.col(right_on).alias("_t"), F.struct(right_on, *values).alias("_right"))
    return (lrows.withColumn("_side", F.lit(1))
            .unionByName(rrows.withColumn("_side", F.lit(0)), allowMissingColumns=True))


def asof_timeline(cold: DataFrame, hot: DataFrame | None, by: Sequence[str], directions: dict[str, str],
                  tolerance_ms: int | None = None) -> DataFrame:
    """`asof` over the two parts of a timeline: ordinary entities, and hot ones in slices (with `_bucket`)."""
    lcols, names = (cold.schema[c].dataType.names for c in ("_left", "_right"))
    right_on = names[0]

    def nearest(direction: str, w, found: Column) -> Column:
        order = F.col("_t").asc() if direction == "backward" else F.col("_t").desc()
        return F.last(found, ignorenulls=True).over(w(order, "_side").rowsBetween(Window.unboundedPreceding, 0)).alias(f"_{direction}")

    plain = lambda *order: Window.partitionBy(*by).orderBy(*order)
    out = cold.select("_t", "_side", "_left", *[nearest(d, plain, F.col("_right")) for d in directions]).filter(F.col("_side") == 1)
    if hot is not None:
        right_t = F.when(F.col("_side") == 0, F.col("_t"))
        per = hot.groupBy(*by, BUCKET).agg(F.max_by("_right", right_t).alias("_hi"), F.min_by("_right", right_t).alias("_lo"))
        scan = Window.partitionBy(*by).orderBy(BUCKET)
        seeds = per.select(
            *by, BUCKET, F.lit(0).alias(SEED),
            F.last("_hi", ignorenulls=True).over(scan.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
            F.first("_lo", ignorenulls=True).over(scan.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
        work = hot.withColumn(SEED, F.lit(1)).unionByName(seeds, allowMissingColumns=True)
        bucket = lambda *order: in_bucket(by, *order)
        carried = {"backward": "_before", "forward": "_after"}
        work = work.select("_t", "_side", "_left", SEED, *[nearest(d, bucket, F.coalesce(F.col("_right"), F.col(carried[d]))) for d in {**directions, "backward": ""}])
        if "forward" in directions:     # a cut may lie inside an instant: its right row is then in an earlier bucket
            now = F.when(F.col("_backward")[right_on] == F.col("_t"), F.col("_backward"))
            work = work.withColumn("_forward", F.coalesce(now, F.col("_forward")))
        work = work.filter((F.col(SEED) == 1) & (F.col("_side") == 1))
        out = out.unionByName(work.select(out.columns))
    shown = [F.col(f"_left.{c}").alias(c) for c in lcols]
    for direction, prefix in directions.items():
        match = F.col(f"_{direction}")
        if tolerance_ms is not None:
            near = F.abs(F.col("_t") - match[right_on]) <= tolerance_ms
            match = F.when(near, match)
        shown += [match[n].alias(prefix + n) for n in names]
    return out.select(*shown)


def affine_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: Column, shift: Column,
                name: str) -> DataFrame:
    """Running value of the recurrence  y = weight * y_before + shift  per key, in order, from y = 0.

    `weight` must lie in [0, 1]; weight 0 restarts the recurrence. Written with running products,
    cut into segments before a product can underflow: after a factor of 2^-192 the earlier value no
    longer shows in a double. A single weight below 2^-64 counts as a restart for the same reason."""
    keys, order = list(keys), list(order)
    work = (df.withColumn("_af_w", F.when(weight < 2.0 ** -64, F.lit(0.0)).otherwise(weight))
            .withColumn("_af_b", shift))
    # Lost bits so far, a restart counting as more than any segment: segments never span a restart.
    loss = F.when(F.col("_af_w") == 0, F.lit(1024.0)).otherwise(-F.log2("_af_w"))
    whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    work = work.withColumn("_af_cut", F.floor(F.sum(loss).over(whole) / 256).cast("long"))
    seg = Window.partitionBy(*keys, "_af_cut").orderBy(*order)
    upto = seg.rowsBetween(Window.unboundedPreceding, 0)
    # A segment's product starts at 1: the weight of its first row acts on the value carried in.
    work = work.withColumn("_af_start", F.row_number().over(seg) == 1)
    work = work.withColumn(
        "_af_p", F.product(F.when(F.col("_af_start"), F.lit(1.0)).otherwise(F.col("_af_w"))).over(upto))
    work = work.withColumn("_af_own", F.col("_af_p") * F.sum(F.col("_af_b") / F.col("_af_p")).over(upto))
    # The same sort order as the segments, so this window and the next need no further sort.
    before = F.lag("_af_own").over(Window.partitionBy(*keys).orderBy("_af_cut", *order))
    work = work.withColumn("_af_in", F.when(F.col("_af_start"), F.coalesce(before * F.col("_af_w"), F.lit(0.0))))
    carried = F.first("_af_in", ignorenulls=True).over(upto)
    return (work.withColumn(name, F.col("_af_own") + F.col("_af_p") * carried)
            .drop("_af_w", "_af_b", "_af_cut", "_af_start", "_af_p", "_af_own", "_af_in"))
