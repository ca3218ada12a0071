"""Processed tables: incremental normalization of raw files, readers, unions.

A table is partitioned by date; `run` and `at` tell the raw file of a row and the offset of the gzip member it comes from. The
ledger has, for every file, how far it has been read. A file that has grown is read from there on. Rows are
replaced by place: whatever a table holds of a file from the offset on where a reading began goes before the rows of that
reading come. A run that was stopped anywhere can therefore be run again: nothing is lost, nothing comes twice."""

from __future__ import annotations

import time
import uuid
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.latest import dedup_equity
from ..schemas import TABLES
from ..session import shared
from .members import listed, read_members
from .raw import BUILDERS, parse_records

SETTLE_SECONDS = 300
FILES_PER_DATE = 64         # a date with as many files is written anew
LEDGER, QUARANTINE, STAGED = "_normalized", "_quarantine", "_staged"
LEDGER_SCHEMA = "path string, mtime long, size long, resume long, before binary, state string, read_at long"


def _hadoop(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _exists(spark: SparkSession, path: str) -> bool:
    store, hadoop = _hadoop(spark, path)
    return store.exists(hadoop)


def _delete(spark: SparkSession, path: str) -> None:
    store, hadoop = _hadoop(spark, path)
    store.delete(hadoop, True)


def _children(spark: SparkSession, path: str) -> list[str]:
    store, hadoop = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(hadoop)) if store.exists(hadoop) else []


def table_schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table] + ", run string, at long, date string")


def read_table(spark: SparkSession, root: str, table: str, first: date | str | None = None, last: date | str | None = None,
               dates: DataFrame | None = None) -> DataFrame | None:
    """A processed table with its fixed schema, None when there is none yet.

    Of the dates from `first` to `last` (inclusive, ISO text or dates) only those partitions are listed and read. `dates` (a
    frame with a column `date`) restricts the table to its dates by a semi-join: what it filters is known at run time,
    and Spark then prunes the partitions by its result."""
    path = f"{root}/{table}"
    if not _exists(spark, path):
        return None
    out = spark.read.schema(table_schema(table)).parquet(path)
    if first is not None:
        out = out.filter(F.col("date") >= str(first))
    if last is not None:
        out = out.filter(F.col("date") <= str(last))
    if dates is not None:
        out = out.join(dates.select("date"), "date", "left_semi")
    return out.select(*table_schema(table).names)


def drifted_columns(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Where the files of a table depart from its schema: column, expected, found (types; null where one has no such column)
    and files (with that type). Older files may lack columns, which are read as null, or hold them with another type."""
    expected = {f.name: f.dataType.simpleString() for f in table_schema(table) if f.name != "date"}
    names = spark.createDataFrame(list(expected.items()), "column string, expected string")
    path = f"{root}/{table}"
    if not _exists(spark, path):
        return names.filter("false").select("column", "expected", F.lit(None).cast("string").alias("found"), F.lit(0).cast("long").alias("files"))
    # The footers are read by tasks, file by file.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    footers = files.select(F.col("_metadata.file_path").alias("path")).mapInArrow(_footers, "path string, column string, found string")
    types = footers.groupBy("column", "found").agg(F.count(F.lit(1)).alias("files"))
    total = footers.select("path").distinct().count()
    held = types.groupBy("column").agg(F.sum("files").alias("held"))
    lacking = names.join(held, "column", "left").select("column", "expected", F.lit(None).cast("string").alias("found"),
                                                        (F.lit(total) - F.coalesce("held", F.lit(0))).alias("files")).filter("files > 0")
    other = types.join(names, "column", "left").filter("not (found <=> expected)").select("column", "expected", "found", "files")
    return lacking.unionByName(other)


def _footers(batches):
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import from_arrow_schema

    from .members import open_file

    for batch in batches:
        for path in batch.column("path").to_pylist():
            with open_file(path) as file:
                fields = from_arrow_schema(pq.read_schema(file)).fields
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(fields), pa.string()), pa.array([f.name for f in fields], pa.string()),
                                              pa.array([f.dataType.simpleString() for f in fields], pa.string())], ["path", "column", "found"])


def equity_union(*tables: DataFrame | None) -> DataFrame:
    """Equity tables as one, one row per (user, period, time_ms); absent tables are skipped."""
    present = [t for t in tables if t is not None]
    if not present:
        raise ValueError("no equity table yet")
    out = present[0]
    for t in present[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return dedup_equity(out.select("user", "period", "time_ms", "account_value", "pnl"))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The last entry of every file: path, mtime, size, resume (where the next reading begins), before, state."""
    if not _exists(spark, ledger):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    rest = [c for c in StructType.fromDDL(LEDGER_SCHEMA).names if c not in ("path", "read_at")]
    entries = spark.read.schema(LEDGER_SCHEMA).parquet(ledger)
    return entries.groupBy("path").agg(F.max_by(F.struct(*rest), "read_at").alias("e")).select("path", "e.*")


def pending_files(spark: SparkSession, raw_dir: str, ledger: str, settle_seconds: int = SETTLE_SECONDS) -> DataFrame:
    """Raw files that are new or have changed since they were read and are no longer being written, as
    (path, mtime, size, start, before). A file that has become longer is read from where the last reading ended; one that
    has not, yet has changed, from its beginning."""
    cutoff = datetime.now(timezone.utc) - timedelta(seconds=settle_seconds)
    files = listed(spark, raw_dir, modifiedBefore=cutoff.strftime("%Y-%m-%dT%H:%M:%S"))
    known = read_ledger(spark, ledger).select("path", *[F.col(c).alias(f"_{c}") for c in ("mtime", "size", "resume", "before")])
    changed = files.join(known, "path", "left").filter("_mtime is null or mtime <> _mtime or size <> _size")
    grown = F.col("size") > F.col("_size")
    return changed.select("path", "mtime", "size", F.when(grown, F.col("_resume")).otherwise(0).cast("long").alias("start"),
                          F.when(grown, F.col("_before")).alias("before"))


def _date() -> Column:
    found = F.regexp_extract("path", r"date=([^/]+)/", 1)
    return F.when(found != "", found).otherwise("undated")


def _run() -> Column:
    return F.regexp_extract("path", r"([^/]+?)(\.jsonl|\.txt)?\.gz$", 1)


def _write(df: DataFrame, path: str, mode: str) -> None:
    """By date: adaptive execution splits the rows of a large date and puts small ones together."""
    (df.hint("rebalance", "date").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path))


def finish_rewrites(spark: SparkSession, out_dir: str, table: str) -> None:
    """Put the complete new contents of dates in the place of the old ones, also those that a stopped run left; a staged
    table without its success mark is deleted."""
    for name in _children(spark, f"{out_dir}/{STAGED}/{table}"):
        staged = f"{out_dir}/{STAGED}/{table}/{name}"
        if _exists(spark, f"{staged}/_SUCCESS"):
            _write(spark.read.schema(table_schema(table)).parquet(staged), f"{out_dir}/{table}", "overwrite")
        _delete(spark, staged)


def write_table(rows: DataFrame, replaced: DataFrame, out_dir: str, table: str, files_per_date: int = FILES_PER_DATE) -> None:
    """Bring new rows (with date, run, at) into a table. `replaced` (date, run, start) has the readings they come from.

    A date is appended to, unless it holds rows that are replaced, or `files_per_date` files or more: then it is written
    anew, which also puts its files together. New contents are complete in a staged table before an old one goes."""
    spark, path = rows.sparkSession, f"{out_dir}/{table}"
    # The same files, in the columns and order of the table.
    rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table_schema(table)])
    touched = replaced.select("date").distinct()
    current = read_table(spark, out_dir, table, dates=touched)
    if current is None:
        return _write(rows, path, "append")
    old = (F.col("o.date") == F.col("r.date")) & (F.col("o.run") == F.col("r.run")) & (F.col("o.at") >= F.col("r.start"))
    conflicts = current.alias("o").join(replaced.alias("r"), old, "left_semi").select("date")
    files = spark.read.schema(table_schema(table)).parquet(path).select("date", F.col("_metadata.file_path").alias("file"))
    crowded = files.join(touched, "date", "left_semi").distinct().groupBy("date").count().filter(F.col("count") >= files_per_date).select("date")
    anew = shared(conflicts.unionByName(crowded).distinct())
    if anew.isEmpty():
        return _write(rows, path, "append")
    staged = f"{out_dir}/{STAGED}/{table}/{uuid.uuid4().hex}"
    kept = current.join(anew, "date", "left_semi").alias("o").join(replaced.alias("r"), old, "left_anti")
    _write(kept.unionByName(rows.join(anew, "date", "left_semi")), staged, "append")       # an overwrite by partition leaves no success mark
    _write(rows.join(anew, "date", "left_anti"), path, "append")
    # Dates, as many as the calendar has.
    emptied = anew.join(spark.read.schema(table_schema(table)).parquet(staged).select("date").distinct(), "date", "left_anti").collect()
    finish_rewrites(spark, out_dir, table)
    for r in emptied:
        _delete(spark, f"{path}/date={r.date}")


def normalize_dataset(spark: SparkSession, raw_dir: str, dataset: str, out_dir: str, settle_seconds: int = SETTLE_SECONDS,
                      quarantine: str | None = None, files_per_date: int = FILES_PER_DATE) -> int:
    """Bring the tables of one dataset up to date with the files of a folder; how many files were read.

    File names, offsets and states stay in tables, and one job chain reads all files. A file with damage other than an early
    end gives no rows (those of earlier readings stay) and goes to the quarantine, as do lines that are no complete
    record; it is read again when it changes."""
    ledger = f"{out_dir}/{LEDGER}/{dataset}"
    for table, _ in BUILDERS[dataset]:
        finish_rewrites(spark, out_dir, table)
    pending = shared(pending_files(spark, raw_dir, ledger, settle_seconds))
    n = pending.count()
    if not n:
        return 0
    lines, states = read_members(pending)
    parsed = parse_records(lines)
    tagged = parsed.filter(F.col("_corrupt").isNull()).drop("_corrupt").withColumn("date", _date()).withColumn("run", _run())
    replaced = shared(states.filter("state <> 'damaged'").select(_date().alias("date"), _run().alias("run"), "start"))
    for table, build in BUILDERS[dataset]:
        write_table(build(tagged), replaced, out_dir, table, files_per_date)
    bad = parsed.filter(F.col("_corrupt").isNotNull()).select("path", F.lit("incomplete record").alias("reason"), F.col("_corrupt").alias("line"))
    damaged = states.filter("state = 'damaged'").select("path", F.lit("damaged file").alias("reason"), F.lit(None).cast("string").alias("line"))
    bad.unionByName(damaged).write.mode("append").parquet(quarantine or f"{out_dir}/{QUARANTINE}/{dataset}")
    # Last: until the ledger says so, the files are pending. A damaged file begins anew.
    sound = F.col("state") != "damaged"
    entries = states.join(pending.select("path", "mtime"), "path").select(
        "path", "mtime", "size", F.when(sound, F.col("resume")).otherwise(0).alias("resume"), F.when(sound, F.col("before")).alias("before"),
        "state", F.lit(time.time_ns()).alias("read_at"))
    entries.write.mode("append").parquet(ledger)
    return n


def normalize_incremental(spark: SparkSession, raw_root: str, out_dir: str, datasets: list[str] | None = None,
                          settle_seconds: int = SETTLE_SECONDS) -> dict[str, int]:
    """Bring the processed tables up to date with raw_root/<dataset>/date=.../<run>.jsonl.gz.

    Returns the number of files read per dataset."""
    return {d: normalize_dataset(spark, f"{raw_root}/{d}", d, out_dir, settle_seconds)
            for d in datasets or list(BUILDERS) if _exists(spark, f"{raw_root}/{d}")}
