"""Streaming counterparts of the polling loops.

All state is bounded by the watermark. Sinks are files or foreachBatch writes with a checkpoint in the
shared folder, so a restarted query continues where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import new_folder
from ..sources.members import FILE_PATTERN
from ..sources.tables import SETTLE_SECONDS, normalize_dataset


def event_time(df: DataFrame, ms: str = "time_ms") -> DataFrame:
    """Adds `event_time` from epoch ms, the column watermarks are declared on."""
    return df.withColumn("event_time", F.timestamp_millis(F.col(ms)))


def stream_ingest(spark: SparkSession, raw_dir: str, dataset: str, out_dir: str, checkpoint: str, quarantine: str | None = None,
                  settle_seconds: int = SETTLE_SECONDS, follow: str | None = None) -> StreamingQuery:
    """Normalize the raw files of one dataset as they come and grow.

    A file source names a path once, whatever is appended later, and offsets of all files would pass the driver with every
    batch. Here the offset of the stream is the ledger of (path, bytes read), a table: a batch lists the folder, and reads
    what lies behind the entries of files that are older than the settle window. Batches may be repeated or stopped
    anywhere (see `sources.tables`). With `follow` (an interval) the stream goes on and looks that often; else it reads what
    is there and stops. Incomplete lines and damaged files go to the quarantine."""
    def read_pending(batch: DataFrame | None = None, batch_id: int = -1) -> None:
        normalize_dataset(spark, raw_dir, dataset, out_dir, settle_seconds, quarantine)

    if follow is not None:
        ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.foreachBatch(read_pending).option("checkpointLocation", checkpoint).trigger(processingTime=follow).start()
    read_pending()
    names = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
             .option("pathGlobFilter", FILE_PATTERN).option("recursiveFileLookup", "true").load(raw_dir).select("path", "modificationTime"))
    return (names.writeStream.foreachBatch(read_pending).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stream_dedup_fills(fills: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Fills once each: overlapping fetches repeat (user, tid, oid) within the watermark delay."""
    return fills.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["user", "tid", "oid"])


def stream_fill_activity(fills: DataFrame, delay: str = "1 hour", max_per_day: int = 500) -> DataFrame:
    """Fills per user and UTC day, with the mark of users too active to follow."""
    day = F.window("event_time", "1 day")
    counts = fills.withWatermark("event_time", delay).groupBy(day, "user").agg(F.count(F.lit(1)).alias("fills"))
    return counts.select(F.unix_millis("window.start").alias("day_ms"), "user", "fills",
                         (F.col("fills") > max_per_day).alias("too_active"))


def stream_last_hour_equity(snapshots: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The last equity snapshot of every book and hour."""
    hour = F.window("event_time", "1 hour")
    last = snapshots.withWatermark("event_time", delay).groupBy(hour, "book_id").agg(
        F.max(F.struct("ts_ms", "equity")).alias("l"))
    return last.select(F.unix_millis("window.start").alias("hour_ms"), "book_id", "l.ts_ms", "l.equity")


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything available into a parquet table of the shared folder and read it back."""
    spark = stream.sparkSession
    out, checkpoint = new_folder(spark, name), new_folder(spark, f"{name}-checkpoint")
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", out)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
