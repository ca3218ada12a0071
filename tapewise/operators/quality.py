"""Data-quality checks over collection runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import HOUR_MS
from ..functions.scan import ROWS_PER_BUCKET, previous, running_max

# Longest accepted age of a job's last finished run, in ms; longest accepted failure rate.
MAX_AGE_MS = {"leaderboard": 3 * HOUR_MS, "wallets": 10 * HOUR_MS, "normalize": 10 * HOUR_MS}
MAX_FAILURE_RATE = 0.10


def fill_gaps(fills: DataFrame) -> DataFrame:
    """Per (user, batch): whether fills may have been lost since the previous batch.

    A fetch starts at the last stored fill, which is returned again; a batch whose oldest fill is newer
    than the cursor has lost what lay between. The batch is the fetch the fill came from (`batch`)."""
    per = fills.groupBy("user", "batch").agg(F.min("time_ms").alias("first_ms"), F.max("time_ms").alias("last_ms"))
    # The cursor never goes back: it is the last fill of any earlier batch.
    reached = running_max(per, ["user"], ["batch"], {"reached_ms": F.col("last_ms")})
    chained = previous(reached, ["user"], ["batch"], {"cursor_ms": F.col("reached_ms")})
    cursor = F.coalesce("cursor_ms", F.lit(0))
    return chained.select("user", "batch", "first_ms", cursor.alias("cursor_ms"),
                          ((cursor > 0) & (F.col("first_ms") > cursor)).alias("gap_suspected"))


def job_freshness(runs: DataFrame, now_ms: int, max_age_ms: dict[str, int] | None = None) -> DataFrame:
    """Per job: when it last finished and whether that is recent enough (runs: job, finished_ms)."""
    limits = max_age_ms or MAX_AGE_MS
    # The rules are a handful of literals, one row per job that must run.
    spark = runs.sparkSession
    sla = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(j).alias("job"), F.lit(a).cast("long").alias("max_age_ms")) for j, a in limits.items()])).alias("r")).select("r.*")
    last = runs.groupBy("job").agg(F.max("finished_ms").alias("finished_ms"))
    age = F.lit(now_ms) - F.col("finished_ms")
    return sla.join(last, "job", "left").select(
        "job", "finished_ms", (age / HOUR_MS).alias("age_h"),
        F.when(age <= F.col("max_age_ms"), "OK").otherwise("FAIL").alias("level"))


def failure_rate(runs: DataFrame, limit: float = MAX_FAILURE_RATE) -> DataFrame:
    """Per run: share of failed items (runs: run, failed) and whether it is acceptable."""
    per = runs.groupBy("run").agg(F.count(F.lit(1)).alias("items"), F.count_if("failed").alias("failures"),
                                  F.count_if("gap_suspected").alias("gaps"))
    rate = F.col("failures") / F.greatest(F.col("items"), F.lit(1))
    return per.select("run", "items", "failures", "gaps", rate.alias("rate"),
                      F.when(rate <= limit, "OK").otherwise("FAIL").alias("level"),
                      F.when(F.col("gaps") > 0, "WARN").otherwise("OK").alias("gap_level"))


def version_changes(observations: DataFrame, ties: Sequence[str] = ("etag",), rows: int = ROWS_PER_BUCKET) -> DataFrame:
    """Source versions when they change (observations: source, seen_ms, etag): first sightings only of
    each run of equal versions. Sightings of one instant are taken in the order of `ties`, so that the
    changes do not depend on how the rows are dealt out."""
    seen = previous(observations, ["source"], ["seen_ms", *ties], {"before": F.col("etag")}, rows)
    return seen.filter(F.col("before").isNull() | (F.col("before") != F.col("etag"))).select(
        "source", "etag", F.col("seen_ms").alias("first_seen_ms"))
