"""Connected components of links between 64-bit node ids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, table


def components(links: DataFrame) -> DataFrame:
    """Written table (node, label) for every node of `links` (a, b: long, not null): label is the smallest node
    reachable. Empty links give an empty table.

    Rounds over written tables, until none changes: a node hears its neighbours' labels, the owner of its old label
    hears the smallest of them too, and labels jump to their own label. Chains shrink geometrically, so the rounds
    grow with the logarithm of a component's diameter. All aggregates combine on the map side, and the joins read
    tables on both sides, so that adaptive execution splits the rows of a hub or of a large component's label."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("peer")),
                             F.struct(F.col("b").alias("node"), F.col("a").alias("peer"))))
    arcs = table(links.filter("a <> b").select(ends.alias("e")).select("e.*").distinct(), "arcs")
    labels = table(arcs.groupBy("node").agg(F.least("node", F.min("peer")).alias("label")), "labels")
    while True:
        heard = arcs.join(labels.select(F.col("node").alias("peer"), F.col("label").alias("near")), "peer").groupBy("node").agg(F.min("near").alias("near"))
        both = labels.join(heard, "node").select("node", "label", F.least("label", "near").alias("near"))
        owners = both.groupBy(F.col("label").alias("node")).agg(F.min("near").alias("low"))
        step = table(both.join(owners, "node", "left").select("node", "label", F.least("near", "low").alias("near")), "step")
        jump = step.select(F.col("node").alias("near"), F.col("near").alias("far"))
        after = table(step.join(jump, "near").select("node", F.col("label").alias("was"), F.least("near", "far").alias("label")), "labels")
        moved = not after.filter("label <> was").isEmpty()
        drop(labels, step)
        labels = after
        if not moved:
            drop(arcs)
            out = labels.drop("was")
            out._written = labels._written
            return out


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union, in place, of the sets of a[i] and b[i]; label[i] is a smaller or equal member of i's set."""
    while True:
        while True:     # every member points at its root
            root = label[label]
            if np.array_equal(root, label):
                break
            label[:] = root
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
