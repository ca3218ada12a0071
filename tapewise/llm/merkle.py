"""A Merkle manifest of a dataset: a hash tree per group of rows, and a tree over the groups.

Rows of a group are numbered by a range sort, so that a group of any size is spread over tasks. A level is one aggregate:
children of a parent are told apart by their slot (number modulo the fanout) and conditional aggregates spread them into
one column per slot. The columns together hash to the parent; without a child's own column they are its siblings. Levels
are written tables of a third of the rows each time. On the way down a parent hands its siblings and those above it to its
children, so that every leaf meets one row, its parent's, whatever the height."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, table, tuck, untuck

PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value with its length in bytes before it, so that neighbours cannot run into each other; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the parts in order; null parts are left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Written table with `place` (0-based within the group, by `order`) and `n` (rows of the group). Groups are compared
    with nulls equal. A range sort: tasks hold runs of the order, also of one large group."""
    keys = [*group, *order]
    part, row = F.spark_partition_id(), F.monotonically_increasing_id()
    runs = table(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "*", part.alias("_part"), (row - F.shiftleft(part.cast("long"), 33)).alias("_row")), "runs")
    # At most one row per task and group border.
    parts = runs.groupBy(*[F.col(g).alias(f"_{g}") for g in group], F.col("_part").alias("_at")).agg(F.min("_row").alias("_low"), F.count(F.lit(1)).alias("_held"))
    whole = Window.partitionBy(*[f"_{g}" for g in group])
    parts = parts.select("*", F.coalesce(F.sum("_held").over(whole.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
                         F.sum("_held").over(whole).alias("n"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group], F.col("_part") == F.col("_at"))
    out = table(runs.join(parts, same).select(*rows.columns, (F.col("_before") + F.col("_row") - F.col("_low")).alias("place"), "n"), "numbered")
    drop(runs)
    return out


def slots(fanout: int) -> list[str]:
    return [f"slot{s}" for s in range(fanout)]


def siblings(own: Column, fanout: int) -> Column:
    """The other slots of a parent's row, on either side of the own one."""
    left, right = ([F.when(beside(s), F.col(c)) for s, c in enumerate(slots(fanout))] for beside in (lambda s: own > s, lambda s: own < s))
    return F.struct(F.concat_ws("", *left).alias("left"), F.concat_ws("", *right).alias("right"))


def levels(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """(parents level by level: tree, place, slots, hash, n; roots: tree, hash, height) over nodes (tree, place, hash, n).

    A tree of one node is its own root: it gets a parent at the first level that only repeats it."""
    out: list[DataFrame] = []
    largest = nodes.agg(F.max("n")).first()[0] or 1
    while not out or largest > 1:
        parent = F.floor(F.col("place") / fanout).cast("long")
        spread = [F.max(F.when(F.col("place") % fanout == s, F.col("hash"))).alias(c) for s, c in enumerate(slots(fanout))]
        up = nodes.groupBy("tree", parent.alias("place")).agg(*spread, F.max("n").alias("nodes"))
        above = F.ceil(F.col("nodes") / fanout).cast("long").alias("n")
        up = up.select("tree", "place", *slots(fanout), "nodes", F.when(F.col("nodes") == 1, F.col("slot0")).otherwise(digest(*map(F.col, slots(fanout)))).alias("hash"), above)
        out.append(table(up, "level"))
        nodes, largest = out[-1].filter("n > 1").select("tree", "place", "hash", "n"), -(-largest // fanout)
    roots = [t.filter("n = 1").select("tree", "hash", F.lit(i + 1).alias("height")) for i, t in enumerate(out)]
    return out, table(reduce(DataFrame.unionByName, roots), "roots")


def with_paths(nodes: DataFrame, parents: list[DataFrame], roots: DataFrame, fanout: int) -> DataFrame:
    """`nodes` with `path`: their siblings level by level up to the root, followed by the path of the root (`roots`: tree,
    height, path)."""
    at = lambda height: roots.filter(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("place"), "path")
    joined = lambda path: F.when(F.col("nodes") == 1, F.col("path")).otherwise(F.concat(F.array(path), F.col("path")))
    above = at(len(parents))
    for height in range(len(parents) - 1, 0, -1):
        child = lambda s, c: F.when(F.col(c).isNotNull(), F.struct((F.col("place") * fanout + s).alias("place"), joined(siblings(F.lit(s), fanout)).alias("path")))
        children = F.explode(F.filter(F.array(*[child(s, c) for s, c in enumerate(slots(fanout))]), lambda x: x.isNotNull())).alias("c")
        down = parents[height].join(above, ["tree", "place"]).select("tree", children).select("tree", "c.place", "c.path")
        above = down.unionByName(at(height))
    own = F.col("place") % fanout
    first = parents[0].drop("hash", "n").join(above, ["tree", "place"]).withColumnRenamed("place", "parent")
    out = nodes.withColumn("parent", F.floor(F.col("place") / fanout).cast("long")).join(first, ["tree", "parent"])
    return out.select(*nodes.columns, joined(siblings(own, fanout)).alias("path"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda below, s: digest(s["left"], below, s["right"]))


def proof(path: Column) -> Column:
    """Hash of all siblings of a path, level by level, left to right."""
    return digest(F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"]))))


def manifest(rows: DataFrame, group: str = "source", order: str = "doc_id", fanout: int = 3) -> DataFrame:
    """`rows`, which hold `leaf`, with subroot (of the row's group), root and path (siblings from the leaf to the root).

    Leaves ascend by `order` within a group; nulls come first, equal ones are ordered by their leaf. Groups ascend
    bytewise, null first, and may hold any share of the rows. A group of one leaf has that leaf as its subroot, a dataset of
    one group has its subroot as root. An empty table gives an empty one. Other columns may have any names but those added."""
    # Equal leaves of one id may stand in any order; by the last key they need not be in one task.
    tucked = tuck(rows, group, order, "leaf").withColumnsRenamed({group: "_group", order: "_order"})
    placed = numbered(tucked.withColumn("_id", F.monotonically_increasing_id()), ["_group"], ["_order", "leaf", "_id"])
    named = placed.select(F.col("_group").alias("_name")).distinct().withColumn("_one", F.lit(0))
    trees = numbered(named, ["_one"], ["_name"]).select("_name", F.col("place").alias("tree"))
    nodes = placed.join(trees, F.col("_group").eqNullSafe(F.col("_name"))).drop("_name", "_id")
    nodes = table(nodes.withColumn("hash", F.col("leaf")), "nodes")
    parents, subroots = levels(nodes.select("tree", "place", "hash", "n"), fanout)
    # The tree of the subroots: its leaves are numbered by group.
    count = subroots.agg(F.count(F.lit(1)).alias("n"))
    tops = table(subroots.crossJoin(F.broadcast(count)).select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), "hash", "n", "height"), "tops")
    upper, root = levels(tops.select("tree", "place", "hash", "n"), fanout)
    ends = root.select("tree", "height", F.array().cast(PATH).alias("path"))
    tops = with_paths(tops, upper, ends, fanout).withColumnRenamed("hash", "subroot")
    tops = table(tops.crossJoin(F.broadcast(root.select(F.col("hash").alias("root")))).select(F.col("place").alias("tree"), "height", "path", "subroot", "root"), "subroots")
    leaves = with_paths(nodes, parents, tops.select("tree", "height", "path"), fanout)
    out = leaves.join(tops.select("tree", "subroot", "root"), "tree").withColumnsRenamed({"_group": group, "_order": order})
    return out.select(*untuck(tucked.withColumnsRenamed({"_group": group, "_order": order}), rows), "subroot", "root", "path")
