"""Tables stored by entity: written once in buckets, scanned again and again without a shuffle.

A hot entity would make its bucket one huge task, so entities with more than `rows` rows lie beside the buckets as the
slices of a range sort (`_bucket`), and every other row in bucketed, sorted files. The ordered scans take both parts as
they are: no count, no exchange and no second slicing."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scan import BUCKET, ROWS_PER_BUCKET, split_hot
from ..session import CLEANUP, new_folder, setting, shared


BUCKET_ROWS = 500_000       # of fills: some 100 MB in a sort


@dataclass(frozen=True)
class Layout:
    """How a table is stored. Choose `buckets` so that one fits a task: about bytes of the table / 256 MB."""

    by: tuple[str, ...]
    order: tuple[str, ...]
    buckets: int
    rows: int = ROWS_PER_BUCKET

    def fitting(self, table_rows: int) -> Layout:
        """The layout with as many buckets as a table of so many rows needs, so that one task can sort a bucket without spilling."""
        return replace(self, buckets=max(self.buckets, -(-table_rows // BUCKET_ROWS)))


@dataclass(frozen=True)
class Stored:
    cold: DataFrame
    hot: DataFrame | None      # with `_bucket`


def write_layout(df: DataFrame, name: str, layout: Layout, path: str | None = None, counts: DataFrame | None = None) -> str:
    """Write `df` as table `name` below `path` (default: a new folder of the shared one) and return the path.
    A table of that name must not exist. Rows with a null key lie in a bucket like any other.

    With `counts` (see `split_hot`) `df` is not counted, and where no entity is hot by them it must be dealt out to
    `layout.buckets` tasks by `layout.by` already: it is written as it comes, without a copy or another shuffle."""
    path = path or new_folder(df.sparkSession, name)
    cold, hot = split_hot(shared(df) if counts is None else df, layout.by, layout.order, layout.rows, counts)
    # One file per bucket: rows are dealt out as the buckets are.
    dealt = cold if counts is not None and hot is None else cold.repartition(layout.buckets, *layout.by)
    with setting(df.sparkSession, CLEANUP, "true"):
        (dealt.write.format("parquet").option("path", f"{path}/cold").option("compression", "zstd")
         .bucketBy(layout.buckets, *layout.by).sortBy(*layout.by, *layout.order).saveAsTable(name))
    if hot is None:
        hot = df.limit(0).withColumn(BUCKET, F.lit(0).cast("long"))
    hot.write.parquet(f"{path}/hot")
    return path


def open_layout(spark: SparkSession, name: str, layout: Layout, path: str) -> Stored:
    """The stored table. A session whose catalog does not know it (no shared metastore) gets its definition from the files."""
    hot = spark.read.parquet(f"{path}/hot")        # has files, rows or not; buckets without rows have none
    if not spark.catalog.tableExists(name):
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hot.drop(BUCKET).schema)
        names = lambda cols: ", ".join(f"`{c}`" for c in cols)
        spark.sql(f"create table `{name}` ({fields}) using parquet clustered by ({names(layout.by)}) "
                  f"sorted by ({names((*layout.by, *layout.order))}) into {layout.buckets} buckets location '{path}/cold'")
    return Stored(spark.table(name), None if hot.isEmpty() else hot)
