"""Ranks, positions and exact quantiles of groups that may be larger than one task.

The value axis is cut into a fixed, order-preserving grid of buckets (64 per power of two), so a
cross-section of any size is spread over many tasks; only one count per bucket is scanned per group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared
from .exprs import col, finite
from .scan import BUCKET, SEED, drop_seeds, in_bucket, seeded

PER_OCTAVE = 64
# Larger than 64 * 1074, the grid cell of the smallest positive double.
GRID_OFFSET = 70_000
ROWS_PER_GROUP = 100_000    # of a group whose values are sorted in memory


def value_bucket(v: Column | str) -> Column:
    """A grid cell that never decreases as the (finite) value grows."""
    v = col(v).cast("double")
    cell = F.floor(F.log2(F.abs(v)) * PER_OCTAVE) + GRID_OFFSET
    return F.when(v > 0, cell).when(v < 0, -cell).otherwise(F.lit(0)).cast("long")


def _cumulative(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Adds `_cum` (rows with a value up to this one) and `_n` (rows of the group) to value counts."""
    per = (counts.withColumn(BUCKET, value_bucket(value)).groupBy(*keys, BUCKET)
           .agg(F.sum("_c").alias("_bc")))
    group = Window.partitionBy(*keys)
    before = group.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    seeds = per.select(*keys, BUCKET, F.lit(0).alias(SEED),
                       F.coalesce(F.sum("_bc").over(before), F.lit(0)).alias("_c"),
                       F.sum("_bc").over(group).alias("_total"))
    rows = (counts.withColumn(BUCKET, value_bucket(value)).withColumn(SEED, F.lit(1))
            .unionByName(seeds, allowMissingColumns=True))
    upto = in_bucket(keys, value).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", F.sum("_c").over(upto).alias("_cum"), F.first("_total", ignorenulls=True).over(upto).alias("_n"))
    return drop_seeds(rows, "_total")


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows per distinct finite value, combined on the map side: ties of any size become one row."""
    return (df.filter(finite(value)).groupBy(*keys, F.col(value).cast("double").alias(value))
            .agg(F.count(F.lit(1)).alias("_c")))


def ranked(df: DataFrame, keys: Sequence[str], value: str, rank: str = "rank",
           extra: Sequence[str] = (), counted: DataFrame | None = None) -> DataFrame:
    """Adds the average rank (1 = smallest, ties share their mean rank) of finite values per group,
    null for other values.

    `extra` may name "n" (finite values in the group), "above" (rows with a greater value),
    "below" and "ties" (rows with the same value, itself included). `counted` may be another frame with the same keys and
    values that is cheaper to count."""
    cum, c, n = F.col("_cum"), F.col("_c"), F.col("_n")
    made = {"n": n, "above": n - cum, "below": cum - c, "ties": c}
    ranks = _cumulative(value_counts(df if counted is None else counted, keys, value), keys, value).select(
        *keys, F.col(value), (cum - c + (c + 1) / 2).alias(rank), *[made[e].alias(e) for e in extra])
    # An equi-join on (keys, value): adaptive execution splits the rows of a value shared by many.
    joined = df.alias("l").join(
        ranks.alias("r"),
        [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
        + [F.col(f"l.{value}").cast("double") == F.col(f"r.{value}")], "left")
    return joined.select("l.*", f"r.{rank}", *[f"r.{e}" for e in extra])


def text_position(df: DataFrame, keys: Sequence[str], text: str, pos: str) -> DataFrame:
    """Adds each row's 1-based position in ascending text order within its group.

    The rows are range-sorted by (keys, text) and written once, so slices are balanced whatever start the texts
    share; one count per slice tells the positions before it."""
    slices = shared(df.repartitionByRange(*keys, text).withColumn(BUCKET, F.spark_partition_id().cast("long")))
    rows = seeded(slices, keys, {"_before": (F.count(F.lit(1)), F.sum)})
    w = in_bucket(keys, text)
    offset = F.first("_before", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    seeds_so_far = F.sum(1 - F.col(SEED)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select("*", (F.row_number().over(w) - seeds_so_far + F.coalesce(offset, F.lit(0))).alias(pos))
    return drop_seeds(rows, "_before")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    medians: str | None = "median", nearest: dict[str, float] | None = None,
                    size: str | None = None) -> DataFrame:
    """Exact median and nearest-rank quantiles of the finite values per group.

    `nearest` maps a column name to a probability q: the value at 0-based index round((n - 1) q),
    halves rounded up. Equal values are counted first, on the map side, so a value that most rows share is one row per
    task; a histogram of the counts over grid cells finds the cells that hold the wanted ranks, and only the values of
    those cells are scanned. No group is ever collected."""
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    wanted = {name: F.floor((F.col("_n") - 1) * q + 0.5) + 1 for name, q in (nearest or {}).items()}
    ranks = list(wanted.values()) + ([low, high] if medians else [])
    counts = df.filter(finite(value)).groupBy(*keys, value_bucket(value).alias(BUCKET), F.col(value).cast("double").alias("_value")).agg(
        F.count(F.lit(1)).alias("_c"))
    hist = counts.groupBy(*keys, BUCKET).agg(F.sum("_c").alias("_c"))
    group = Window.partitionBy(*keys)
    before = group.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    cells = hist.select("*", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"),
                        F.sum("_c").over(group).alias("_n"))
    covers = lambda r: (F.col("_before") < r) & (r <= F.col("_before") + F.col("_c"))
    cells = cells.filter(reduce(lambda a, b: a | b, [covers(r) for r in ranks])).drop("_c")
    hit = counts.join(cells.withColumnRenamed("_before", "_b"), [*keys, BUCKET])
    upto = Window.partitionBy(*keys, BUCKET).orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    hit = hit.withColumn("_before", F.col("_b") + F.coalesce(F.sum("_c").over(upto), F.lit(0)))
    pick = lambda r: F.max(F.when(covers(r), F.col("_value")))
    aggs = [((pick(low) + pick(high)) / 2).alias(medians)] if medians else []
    aggs += [pick(r).alias(name) for name, r in wanted.items()]
    aggs += [F.max("_n").alias(size)] if size else []
    return hit.groupBy(*keys).agg(*aggs)


def collected_quantiles(df: DataFrame, keys: Sequence[str], values: dict[str, Column], nearest: dict[str, float] | None = None) -> DataFrame:
    """`exact_quantiles` of several columns at once, for groups small enough to sort in memory (see `split_large`): the medians
    under the columns' names, nearest-rank quantiles as "<column>_<name>". One shuffle, whatever the number of columns."""
    lists = df.groupBy(*keys).agg(*[F.sort_array(F.collect_list(F.when(finite(v), v.cast("double") + 0.0))).alias(n) for n, v in values.items()])

    def at(n: str, place: Column) -> Column:
        return F.get(F.col(n), place.cast("int"))

    last = lambda n: F.size(n) - 1
    return lists.select(
        *keys, *[((at(n, F.floor(last(n) / 2)) + at(n, F.ceil(last(n) / 2))) / 2).alias(n) for n in values],
        *[at(n, F.floor(last(n) * q + 0.5)).alias(f"{n}_{c}") for c, q in (nearest or {}).items() for n in values])


def split_large(df: DataFrame, keys: Sequence[str], rows: int = ROWS_PER_GROUP) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups of at most `rows` rows, rows of larger groups or None)."""
    large = shared(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows).drop("_n"))
    if large.isEmpty():
        return df, None
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(large[k]) for k in keys])
    return df.join(large, same, "left_anti"), df.join(large, same, "left_semi")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows per group. Spark prunes each map task to n rows per group before the shuffle
    (window group limit; top-k without keys), so group size does not matter."""
    if keys:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
    best = df.orderBy(*order).limit(n).withColumn("_one", F.lit(1))
    return best.withColumn(rank, F.row_number().over(Window.partitionBy("_one").orderBy(*order))).drop("_one")
