"""Centroid clustering over dictionaries of subvectors.

Vectors are cut into blocks of a few dimensions, and a slice of vectors is written as one row: for every block the distinct
subvectors that occur in it, and the code of each vector's subvector. Nothing is lost. In a round, the distances of all
centroids to every distinct subvector are computed once, a vector's distances are the sums of those its codes name, and
the new sums of a cluster come from how often it holds each code. All arithmetic is on integers and exact.

The dictionaries belong to a slice, as those of a column file do: they stay as small as the slice whatever the input, a
round reads the written slices and shuffles one row per (slice, cluster, component), and nothing is joined. A slice
that is lost is read again. The driver holds the centroids alone."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, table

LIMIT = 1 << 27         # below it, a squared distance of 64 components fits a long


def encode_block(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, code of every row) of one block of integer components."""
    keys = np.ascontiguousarray(values.astype(np.int32)).view(np.dtype((np.void, 4 * values.shape[1]))).ravel()
    _, first, codes = np.unique(keys, return_index=True, return_inverse=True)
    return values[first], codes.astype(np.uint32)


def partial_distances(distinct: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(distinct subvectors x centroids): squared distances within the block."""
    apart = distinct.astype(np.int64)[:, None, :] - centroids.astype(np.int64)[None]
    return (apart * apart).sum(axis=2)


class Slice:
    """The vectors of one written row: their blocks' distinct subvectors and codes."""

    def __init__(self, distinct: list[bytes], codes: list[bytes], width: int, dims: int):
        widths = [min(width, dims - a) for a in range(0, dims, width)]
        self.distinct = [np.frombuffer(d, np.int32).reshape(-1, w) for d, w in zip(distinct, widths)]
        self.codes = [np.frombuffer(c, np.uint32) for c in codes]

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of every vector; of equally near ones the first."""
        total, at = np.zeros((len(self.codes[0]), len(centroids)), np.int64), 0
        for distinct, codes in zip(self.distinct, self.codes):
            total += partial_distances(distinct, centroids[:, at:at + distinct.shape[1]])[codes]
            at += distinct.shape[1]
        cluster = total.argmin(axis=1)
        return cluster, np.take_along_axis(total, cluster[:, None], 1)[:, 0]

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """(clusters x components) sums of the vectors, by counts of codes."""
        out = []
        for distinct, codes in zip(self.distinct, self.codes):
            times = np.bincount(cluster * len(distinct) + codes, minlength=k * len(distinct)).reshape(k, -1)
            out.append(times @ distinct.astype(np.int64))
        return np.concatenate(out, axis=1)


def encode(vectors: DataFrame, dims: int, scale: int, width: int, rows: int) -> DataFrame:
    """Written slices (vec_ids, distinct, codes) of all vectors with exactly `dims` components, none null or non-finite."""
    vec = F.col("embedding").cast("array<double>")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).filter((F.size("vec") == dims) & finite)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, n = [], [], 0

        def close() -> pa.RecordBatch:
            values = np.concatenate(held)
            blocks = [encode_block(values[:, a:a + width]) for a in range(0, dims, width)]
            return pa.RecordBatch.from_arrays(
                [pa.array([sum(ids, [])], pa.list_(pa.int64())), pa.array([[d.astype(np.int32).tobytes() for d, _ in blocks]], pa.list_(pa.binary())),
                 pa.array([[c.tobytes() for _, c in blocks]], pa.list_(pa.binary()))], ["vec_ids", "distinct", "codes"])

        for batch in batches:
            flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
            scaled = np.floor(scale * flat)
            if batch.num_rows and np.abs(scaled).max() >= LIMIT:
                raise ValueError(f"a component times {scale} reaches {LIMIT}: its squared distances fit no long")
            every = batch.column("vec_id").to_pylist()
            for a in range(0, batch.num_rows, rows):
                take = scaled[a:a + rows].astype(np.int64)
                if n + len(take) > rows and held:
                    yield close()
                    ids, held, n = [], [], 0
                ids.append(every[a:a + rows])
                held.append(take)
                n += len(take)
        if held:
            yield close()

    return table(kept.mapInArrow(run, "vec_ids array<long>, distinct array<binary>, codes array<binary>"), "slices")


def seeds(vectors: DataFrame, dims: int, scale: int, k: int, salt: int) -> np.ndarray:
    """The k kept vectors with the smallest sha256 of `salt:vec_id`, in that order; fewer if there are fewer. Vectors
    without an id come last, equal ids in the order of their components."""
    vec = F.col("embedding").cast("array<double>")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.select("vec_id", vec.alias("vec")).filter((F.size("vec") == dims) & finite)
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("long").cast("string")), 256)
    chosen = kept.select(digest.alias("h"), "vec").orderBy(F.asc_nulls_last("h"), "vec").limit(k).collect()
    return np.floor(scale * np.array([r.vec for r in chosen], np.float64).reshape(-1, dims)).astype(np.int64)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: int = 3, width: int = 2,
            rows: int = 1 << 15) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding) whose vector has exactly `dims` components, none null or non-finite:
    vec_id, cluster, distance (squared, of components floor(scale * x)), cluster_inertia, inertia, centroid_sha256.

    Repeated rows and ids are vectors of their own; a null vec_id is kept and is the last choice for a first centroid. With
    fewer than k vectors there are as many clusters as vectors; an empty table gives an empty one. `width` dimensions
    make a block, `rows` vectors a slice, which bounds the memory of a task. Other columns are ignored. Components of
    2**27 or more after scaling raise an error: their distances have no exact long."""
    spark = vectors.sparkSession
    written = encode(vectors, dims, scale, width, rows)
    centroids = seeds(vectors, dims, scale, k, salt)
    k = len(centroids)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for distinct, codes in zip(batch.column("distinct"), batch.column("codes")):
                part = Slice(distinct.as_py(), codes.as_py(), width, dims)
                near, _ = part.nearest(centroids)
                # Component -1 counts the vectors.
                sums = np.concatenate([np.bincount(near, minlength=k)[:, None], part.sums(near, k)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.arange(k, dtype=np.int32), dims + 1)), pa.array(np.tile(np.arange(-1, dims, dtype=np.int32), k)),
                     pa.array(sums.ravel())], ["cluster", "component", "total"])

    for _ in range(rounds if k else 0):
        totals = written.select("distinct", "codes").mapInArrow(tally, "cluster int, component int, total long").groupBy("cluster", "component").agg(
            F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        found = {(r.cluster, r.component): int(r.total) for r in totals.collect()}       # k * (dims + 1) rows
        # Floors of exact sums: integers of any size.
        centroids = np.array([[found[c, d] // found[c, -1] for d in range(dims)] if found[c, -1] else centroids[c].tolist() for c in range(k)], np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, distinct, codes in zip(batch.column("vec_ids"), batch.column("distinct"), batch.column("codes")):
                near, distance = Slice(distinct.as_py(), codes.as_py(), width, dims).nearest(centroids)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(near.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = table(written.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    drop(written)
    names = spark.createDataFrame([(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())],
                                  "cluster int, centroid_sha256 string")
    by_cluster = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part"))
    whole = by_cluster.agg(F.sum("part").cast("long").alias("inertia"))
    # One row per cluster: k rows.
    sums = by_cluster.select("cluster", F.col("part").cast("long").alias("cluster_inertia")).join(names, "cluster").crossJoin(F.broadcast(whole))
    return assigned.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
