"""Exit rules on a stream of fills, with the fills of the window as keyed state.

The state is a table of the fills inside the window, in buckets of users. A batch reads the buckets of the users that it has to
look at, and writes new versions of those; a small marker per batch names the current version of every bucket, and is
written last. A batch that is repeated starts from the marker before it and writes the same versions again, so nothing is
lost or counted twice; the versions that only the marker before that one names are deleted. Stored history is not read."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.exprs import DAY_MS
from ..operators.behavior import EXIT_RULES, behavior_features, exit_rules
from ..operators.latest import dedup_fills
from ..session import releasing, shared
from ..sources.tables import _children, _delete

BUCKETS = 256
MARKER = "bucket int, version long, now_ms long"


class State:
    """The versions below a folder, as the batch `batch_id` finds them."""

    def __init__(self, spark: SparkSession, folder: str, batch_id: int):
        self.spark, self.folder, self.batch_id = spark, folder, batch_id
        batches = sorted(int(name.partition("=")[2]) for name in _children(spark, f"{folder}/markers") if name.startswith("batch="))
        earlier = [b for b in batches if b < batch_id and self._marked(b)]
        self.batch, self.before = (earlier or [None])[-1], earlier[:-1]
        self.versions, self.now_ms = self._marker(self.batch)

    def _marked(self, batch: int) -> bool:
        return "_SUCCESS" in _children(self.spark, f"{self.folder}/markers/batch={batch}")

    def _marker(self, batch: int | None) -> tuple[dict[int, int], int | None]:
        if batch is None:
            return {}, None
        rows = self.spark.read.schema(MARKER).parquet(f"{self.folder}/markers/batch={batch}").collect()      # one row per bucket
        return {r.bucket: r.version for r in rows if r.bucket >= 0}, max((r.now_ms for r in rows if r.now_ms is not None), default=None)

    def _path(self, version: int, bucket: int) -> str:
        return f"{self.folder}/fills/version={version}/bucket={bucket}"

    def read(self, schema: StructType, buckets: list[int] | None = None) -> DataFrame:
        """The fills of some buckets, or of all, with `bucket`."""
        paths = [self._path(v, b) for b, v in self.versions.items() if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/fills").parquet(*paths).select(*schema.names)

    def write(self, fills: DataFrame, buckets: list[int], now_ms: int | None) -> None:
        """New versions of some buckets, the marker, and the end of what no batch can need any more."""
        if buckets:
            # Sorted by time, so that a search for expired fills skips most of a bucket.
            placed = fills.repartition(min(len(buckets), BUCKETS), "bucket").sortWithinPartitions("bucket", "time_ms")
            placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/fills/version={self.batch_id}")
        held = {int(n.partition("=")[2]) for n in _children(self.spark, f"{self.folder}/fills/version={self.batch_id}") if n.startswith("bucket=")} if buckets else set()
        after = {b: v for b, v in self.versions.items() if b not in buckets} | dict.fromkeys(held, self.batch_id)
        rows = [(b, v, now_ms) for b, v in after.items()] + [(-1, None, now_ms)]
        self.spark.createDataFrame(rows, MARKER).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/markers/batch={self.batch_id}")
        for batch in self.before:
            for b, v in self._marker(batch)[0].items():
                if v != self.versions.get(b):
                    _delete(self.spark, self._path(v, b))
            _delete(self.spark, f"{self.folder}/markers/batch={batch}")


def watch_batch(batch: DataFrame, batch_id: int, equity: DataFrame, sink: str, now_ms: int | None = None, window_days: int = 60,
                rules: Sequence[tuple] = EXIT_RULES, buckets: int = BUCKETS) -> None:
    """One batch of fills: rules of the users it brings, and of those with fills that have left the window since."""
    spark = batch.sparkSession
    state = State(spark, f"{sink}/state", batch_id)
    with releasing():
        batch = batch.withColumn("bucket", F.pmod(F.xxhash64("user"), F.lit(buckets)).cast("int"))
        # One row per user of the batch; its fills are read again, those of the window only.
        arrived = shared(batch.groupBy("user", "bucket").agg(F.max("time_ms").alias("time_ms")))
        newest = arrived.agg(F.max("time_ms")).first()[0]
        now = now_ms if now_ms is not None else max((t for t in (newest, state.now_ms) if t is not None), default=None)
        if now is None:
            return state.write(arrived, [], None)
        start = F.col("time_ms") >= now - window_days * DAY_MS
        expired = state.read(batch.schema).filter(~start).select("user", "bucket")
        touched = shared(arrived.select("user", "bucket").unionByName(expired).distinct())
        some = [r.bucket for r in touched.select("bucket").distinct().collect()]        # at most `buckets`
        fills = shared(dedup_fills(state.read(batch.schema, some).unionByName(batch.filter(start)).filter(start)))
        users = touched.select("user")
        features = behavior_features(fills.drop("bucket").join(users, "user", "left_semi"), equity.join(users, "user", "left_semi"), now, window_days, unique=True)
        exit_rules(features, rules).write.mode("overwrite").parquet(f"{sink}/hits/batch={batch_id}")
        users.select(F.col("user").alias("trader")).write.mode("overwrite").parquet(f"{sink}/looked_at/batch={batch_id}")
        state.write(fills, some, now)


def stream_watch(fills: DataFrame, equity: Callable[[], DataFrame], sink: str, checkpoint: str, now_ms: int | None = None, window_days: int = 60,
                 rules: Sequence[tuple] = EXIT_RULES, buckets: int = BUCKETS) -> StreamingQuery:
    """Exit rules over the fills of the last `window_days`, kept up to date by a stream (what is available, then stop).

    Time is that of the newest fill so far, unless `now_ms` fixes it. Every batch writes sink/hits/batch=N and, for all users
    it has looked at, sink/looked_at/batch=N; `current_hits` reads both. Fills may come late, twice and in any order."""
    def watch(batch: DataFrame, batch_id: int) -> None:
        watch_batch(batch, batch_id, equity(), sink, now_ms, window_days, rules, buckets)

    return fills.writeStream.foreachBatch(watch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_hits(spark: SparkSession, sink: str) -> DataFrame:
    """The rules that hold for each user as of the last batch that has looked at them."""
    looked_at = spark.read.option("basePath", f"{sink}/looked_at").schema("trader string, batch long").parquet(f"{sink}/looked_at")
    last = looked_at.groupBy("trader").agg(F.max("batch").alias("batch"))
    hits = spark.read.schema("trader string, rule string, feature string, value double, limit double, n_trades long, actionable boolean, batch long").parquet(f"{sink}/hits")
    return hits.join(last, ["trader", "batch"], "left_semi").drop("batch")
