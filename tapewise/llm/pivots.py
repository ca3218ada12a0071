"""Near-duplicate embeddings by a pivot-permutation index.

Reference points (pivots) that lie far apart are chosen from a bounded sample. A vector is described by its `order`
nearest pivots, nearest first. Its home is the inverted list of the nearest one; as a query it reads the lists of
its `probes` nearest. Within a list, the pivots that query and home vector share are counted through the lists of
the home vectors' descriptions; pairs that share enough are verified by their cosine in double precision. Equal
vectors are one class with a size. A list that is too long is cut into cells of a grid, home blocks by query blocks,
so that no task holds a hot list; a cell emits one row per linked vector, never its pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, table
from .graph import components, merge


def choose_pivots(vectors: np.ndarray, pivots: int, apart: float) -> np.ndarray:
    """Greedily, in the given order: unit vectors whose cosine with every chosen one is below `apart`."""
    chosen = np.empty((0, vectors.shape[1]))
    for v in vectors:
        if len(chosen) == pivots:
            break
        if not len(chosen) or (chosen @ v).max() < apart:
            chosen = np.vstack([chosen, v])
    return chosen


def unit(vectors: np.ndarray) -> np.ndarray:
    """Scaled first, so that neither tiny nor huge components leave the range of a double."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def describe(vectors: np.ndarray, pivots: np.ndarray, order: int) -> np.ndarray:
    """The `order` nearest pivots of each unit vector, nearest first (ties: lower number); -1 where there are fewer."""
    out = np.full((len(vectors), order), -1, np.int32)
    if len(pivots):
        near = np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :order]
        out[:, :near.shape[1]] = near
    return out


def shared_counts(home: np.ndarray, asking: np.ndarray) -> np.ndarray:
    """(queries x home) numbers of pivots in both descriptions, by the inverted lists of the home descriptions."""
    token, row = home.ravel(), np.repeat(np.arange(len(home)), home.shape[1])
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    flat = asking.ravel()
    lo, hi = np.searchsorted(token, flat, "left"), np.searchsorted(token, flat, "right")
    hi = np.where(flat < 0, lo, hi)
    size = hi - lo
    at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    query = np.repeat(np.repeat(np.arange(len(asking)), asking.shape[1]), size)
    return np.bincount(query * len(home) + row[at], minlength=len(asking) * len(home)).reshape(len(asking), len(home))


def near_vectors(vectors: DataFrame, min_cosine: float = 0.98, pivots: int = 256, order: int = 8, probes: int = 5, shared: int = 3,
                 apart: float = 0.5, sample_size: int = 4096, list_size: int = 512) -> DataFrame:
    """One row per row of `vectors` (vec_id long, embedding array, label): vec_id, n_links (other vectors of its label
    with a cosine of at least `min_cosine`), component_id (smallest vec_id that links reach; its own for a row
    without links) and kept (vec_id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite components, and vectors without a label, link with
    nothing; nor do vectors of different lengths. Rows with a null vec_id take part; their kept is false unless nobody
    in their component has an id. The pivots come from the `sample_size` distinct vectors with the smallest hash;
    every vector is indexed and every vector asks. `shared` is at most the pivots there are."""
    spark, element = vectors.sparkSession, vectors.schema["embedding"].dataType.elementType.simpleString()
    element = element if element == "float" else "double"
    kind = np.float32 if element == "float" else np.float64
    vec = F.col("vec")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = vectors.select("vec_id", "label", F.col("embedding").cast(f"array<{element}>").alias("vec"))
    rows = rows.select("vec_id", "label", F.when(F.col("label").isNotNull() & vec.isNotNull() & F.coalesce(finite, F.lit(False)), vec).alias("vec"))
    rows = rows.withColumn("label", F.when(F.col("vec").isNotNull(), F.col("label").cast("string")))
    classes = table(rows.filter("vec is not null").groupBy("label", "vec").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("size"))
                    .select(F.monotonically_increasing_id().alias("cid"), "*"), "classes")

    sample: dict[int, list] = {}
    for r in classes.select("vec").orderBy(F.xxhash64("vec")).limit(sample_size).collect():
        sample.setdefault(len(r.vec), []).append(r.vec)
    chosen = {n: choose_pivots(unit(np.array(v, np.float64)), pivots, apart) for n, v in sample.items()}

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vec")
            sizes = np.diff(np.asarray(lists.offsets))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
            begin = np.cumsum(sizes) - sizes
            for n in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == n)
                vecs = flat[begin[own][:, None] + np.arange(n)]
                near = describe(unit(vecs), chosen.get(n, np.empty((0, n))), order)
                asked = max(1, min(probes, int((near[0] >= 0).sum())))
                for k in range(asked):
                    yield pa.RecordBatch.from_arrays([
                        batch.column("label").take(pa.array(own)), pa.array(np.full(len(own), n, np.int32)), pa.array(near[:, k]),
                        batch.column("cid").take(pa.array(own)), batch.column("size").take(pa.array(own)), pa.array(np.full(len(own), k == 0)),
                        pa.array([x.tobytes() for x in near]), pa.array([x.tobytes() for x in vecs])],
                        ["label", "n", "pivot", "cid", "size", "home", "near", "vec"])

    key = ["label", "n", "pivot"]
    postings = table(classes.select("cid", "label", "vec", "size").mapInArrow(
        post, "label string, n int, pivot int, cid long, size long, home boolean, near binary, vec binary"), "postings")
    lengths = postings.groupBy(*key).agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count(F.lit(1)).alias("asks"))
    grid = lengths.select(*key, F.greatest(F.lit(1), F.ceil(F.col("homes") / list_size)).cast("int").alias("mines"),
                          F.greatest(F.lit(1), F.ceil(F.col("asks") / (2 * list_size))).cast("int").alias("parts"))
    # Both sides are tables with the same key: adaptive execution splits a list that many vectors share.
    placed = postings.join(table(grid, "grid"), key)
    mine, part = F.pmod(F.xxhash64("cid"), "mines"), F.pmod(F.xxhash64(F.lit(1), "cid"), "parts")
    # In cell (i, j), home vectors of block i meet queries of block j.
    asking = F.transform(F.sequence(F.lit(0), F.col("mines") - 1), lambda i: F.struct((i * F.col("parts") + part).cast("int").alias("cell"), F.lit(False).alias("home")))
    at_home = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct((mine * F.col("parts") + j).cast("int").alias("cell"), F.lit(True).alias("home")))
    cells = placed.select(*key, "cid", "size", "near", "vec", F.explode(F.when(F.col("home"), F.concat(asking, at_home)).otherwise(asking)).alias("c"))
    # Dealt out by cell: a partitioning by list alone would bring the cells of a long list together again.
    cells = cells.select(*key, "cid", "size", "near", "vec", "c.cell", "c.home").repartition(*key, "cell")

    def cell_links(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        pivot = int(group[2])
        part = part.sort_values("cid")
        x, y = part[part.home], part[~part.home]
        empty = pd.DataFrame({"cid": [], "links": [], "root": []}).astype("int64")
        if not len(x) or not len(y):
            return empty

        def arrays(p: pd.DataFrame) -> tuple[np.ndarray, ...]:
            return (p.cid.to_numpy(), p["size"].to_numpy(), np.frombuffer(b"".join(p.near), np.int32).reshape(len(p), -1),
                    unit(np.frombuffer(b"".join(p.vec), kind).reshape(len(p), -1)))

        (x_id, x_size, x_near, x_vec), (y_id, y_size, y_near, y_vec) = arrays(x), arrays(y)
        enough = min(shared, int((x_near[0] >= 0).sum()))
        ids = np.union1d(x_id, y_id)
        x_at, y_at = np.searchsorted(ids, x_id), np.searchsorted(ids, y_id)
        label, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        for i in range(0, len(y_id), 256):
            s = slice(i, i + 256)
            found = shared_counts(x_near, y_near[s]) >= enough
            asks = np.flatnonzero(found.any(axis=1))
            if not len(asks):
                continue
            a, b = np.nonzero(found[asks] & (y_vec[s][asks] @ x_vec.T >= min_cosine))
            a = asks[a] + i
            # A pair may meet in the lists of both homes: the lower pivot counts it, within one list the lower id asks.
            other = y_near[a, 0]
            both = ((x_near[b, :probes] == other[:, None]) & (other[:, None] >= 0)).any(axis=1)
            here = np.where(other == pivot, y_id[a] < x_id[b], ~both | (pivot < other))
            a, b = a[here], b[here]
            links += np.bincount(y_at[a], weights=x_size[b], minlength=len(ids)).astype(np.int64)
            links += np.bincount(x_at[b], weights=y_size[a], minlength=len(ids)).astype(np.int64)
            merge(label, y_at[a], x_at[b])
        some = np.flatnonzero(links)
        return pd.DataFrame({"cid": ids[some], "links": links[some], "root": ids[label[some]]})

    found = table(cells.groupBy(*key, "cell").applyInPandas(cell_links, "cid long, links long, root long"), "links")
    groups = components(found.select(F.col("root").alias("a"), F.col("cid").alias("b")))
    tally = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = table(classes.join(tally, "cid", "left").join(groups.select(F.col("node").alias("cid"), F.col("label").alias("linked")), "cid", "left").select(
        F.col("label").alias("c_label"), F.col("vec").alias("c_vec"), "first", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
        F.coalesce("linked", "cid").alias("grp")), "named")
    lowest = table(named.groupBy("grp").agg(F.min("first").alias("component_id")), "lowest")
    final = table(named.join(lowest, "grp").select("c_label", "c_vec", "n_links", "component_id"), "final")
    drop(postings, found, groups, named)
    linked = rows.filter("vec is not null").join(final, (F.col("label") == F.col("c_label")) & (F.col("vec") == F.col("c_vec"))).select("vec_id", "n_links", "component_id")
    alone = rows.filter("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
