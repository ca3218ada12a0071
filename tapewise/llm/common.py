"""What the operators share: written tables, bounded slices of text batches, word counts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs inside go as soon as each job has ended: what follows reads written tables."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def table(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a frame to the shared folder and read it back: computed once, lineage cut, safe against lost
    executors. `drop` deletes it when nothing reads it any more."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with dropping_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by `table`; frames that read them can no longer run."""
    for t in tables:
        hadoop = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written)
        hadoop.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


REST = "_rest"


def tuck(df: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others in one struct: whatever they are called, no name of ours meets theirs."""
    others = [c for c in df.columns if c not in needed]
    return df.select(*needed, *([F.struct(*[f"`{c}`" for c in others]).alias(REST)] if others else []))


def untuck(df: DataFrame, like: DataFrame, *without: str) -> list[Column]:
    """The columns of `like`, in order, from a frame that `tuck` began with; those in `without` are left out."""
    return [F.col(c) if c in df.columns and c != REST else F.col(REST).getField(c).alias(c) for c in like.columns if c not in without]


def n_words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(texts: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch of about `limit` bytes of text each, one row at least."""
    sizes = np.array([0 if not s.is_valid else s.as_buffer().size for s in texts], np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield start, len(sizes)


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b if b is not None else b"" for b in column.cast(kind).to_pylist()]
