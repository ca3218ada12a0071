"""Session helpers: recommended settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on (time zone) or profit from (adaptive execution, skew splitting).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def local_session(app: str = "tapewise", cpus: int | str = "*", memory: str = "12g",
                  shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", memory)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# The adaptors make up to twelve wide rows of one given row, and a stage that expands, sorts and aggregates holds several
# copies of its part: tasks take an eighth of what Spark would give them.
SPLIT_BYTES = PART_BYTES = 16 << 20
BYTES_PER_PARTITION = 2 << 20       # of the given tables, per partition of a shuffle before small ones are merged
UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def _bytes(text: str) -> int:
    number, unit = re.fullmatch(r"\s*(\d+)\s*([bkmgt]?)b?\s*", text.lower()).groups()
    return int(number) * UNITS[unit]


def fit_tasks(spark: SparkSession, table_bytes: int) -> None:
    """Bound what a task holds, however large the tables are: small splits, small merged partitions, and as many partitions
    before merging as the tables ask for. Smaller sizes and more partitions of the session's own stay."""
    for key, most in (("spark.sql.files.maxPartitionBytes", SPLIT_BYTES), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", PART_BYTES)):
        if _bytes(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))
    # Merging after the shuffle starts from this number; without adaptive execution it has no effect.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum",
                   str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table_bytes // BYTES_PER_PARTITION))))


def path_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files below a path; 0 where there is nothing."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(hadoop).getLength() if fs.exists(hadoop) else 0


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster in spark.checkpoint.dir.

    Only a local session may fall back to a temporary folder of this machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="tapewise-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh, unused path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def ensure_checkpoints(spark: SparkSession) -> None:
    """Make DataFrame.checkpoint() write to the shared folder."""
    folder = shared_folder(spark)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting inside the block; afterwards it is as before."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared(df: DataFrame, parts: Sequence[str] = ()) -> DataFrame:
    """Write a frame that several branches of one plan read to a table in the shared folder, and read it
    from there: computed once, its lineage cut, safe against lost executors, columns still pruned.
    `parts` are columns of few values in whose folders the rows lie, so that a filter on them reads no others.

    Shuffle files of the writing go as soon as it has ended: what follows reads the table. The tables stay until
    `release_shared()` (or `forget`)."""
    if getattr(df, "_is_shared", False):
        return df
    spark = df.sparkSession
    path = new_folder(spark, "shared")
    # A task keeps a file open for each value of `parts` instead of sorting its rows.
    with setting(spark, CLEANUP, "true"), setting(spark, "spark.sql.maxConcurrentOutputFileWriters", "8"):
        df.write.option("compression", "zstd").partitionBy(*parts).parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._is_shared, out._shared_path = True, path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def forget(df: DataFrame) -> None:
    """Delete the table that `shared` wrote for this frame; frames built on it can no longer run."""
    path = getattr(df, "_shared_path", None)
    if path:
        _WRITTEN.remove((df.sparkSession, path))
        _delete(df.sparkSession, path)


@contextmanager
def releasing() -> Iterator[None]:
    """Tables that `shared` writes inside are deleted at the end."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        while len(_WRITTEN) > before:
            _delete(*_WRITTEN.pop())


def release_shared() -> None:
    """Delete the tables written by `shared`; frames built on them can no longer run."""
    while _WRITTEN:
        _delete(*_WRITTEN.pop())
