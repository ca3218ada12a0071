"""Near-duplicates by SimHash: fingerprints, and pairs within a few bits by vantage-point trees.

Two fingerprints that differ in at most `bits` bits differ in at most bits // 2 bits in one of their halves. Each half
therefore has its own vantage-point tree under the Hamming distance of that half, whose small radius lets the
triangle bounds prune: a branch is left out if |d(query, vantage point) - boundary| says that nothing in it can
be near. The top of each tree, made from a bounded sample of fingerprints, cuts all of them into shards; a
fingerprint is at home in one shard and visits every other shard that its ball overlaps. Inside a shard the tree
goes on, and leaves compare whole fingerprints. Every pair within `bits` is found: the sample decides only how even
the shards are."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import byte_texts, drop, slices, table, tuck, untuck
from .graph import components, merge
from .paragraphs import near_links as near_sets
from .paragraphs import signatures, tune, units_of

HALF = np.uint64(0xFFFFFFFF)


def text_fingerprints(texts: list[bytes], width: int = 3) -> np.ndarray:
    """SimHash of each text: A-Z lower-cased, words by ASCII white space, shingles of `width` words (the whole
    sequence if there are fewer words, none without a word), XXH64 with seed 42; a bit is 1 if set in over half
    of the shingles, repeats included."""
    import xxhash

    hashes, counts = [], []
    for text in texts:
        words = text.lower().split()        # of bytes: A-Z and ASCII white space only
        if len(words) > width:
            grams = map(b" ".join, zip(*(words[i:] for i in range(width))))
            count = len(words) - width + 1
        else:
            grams, count = ([b" ".join(words)], 1) if words else ((), 0)
        hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, count))
        counts.append(count)
    out, has = np.zeros(len(texts), np.uint64), np.array(counts) > 0
    if has.any():
        sizes = np.array(counts)[has]
        bits = np.unpackbits(np.concatenate(hashes).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int64)
        out[has] = np.packbits(2 * sums > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """`docs` (text, other columns) without text, with `fp`, the fingerprint as a signed long; a column of that name is
    replaced. A null or empty text has fingerprint 0."""
    given = docs.drop("fp")
    docs = tuck(given, "text")
    kept = docs.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for lo, hi in slices(column):
                fp = text_fingerprints(byte_texts(column.slice(lo, hi - lo)), width).view(np.int64)
                rest = [batch.column(c).slice(lo, hi - lo) for c in kept]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(fp)], [*kept, "fp"])

    found = docs.mapInArrow(run, StructType([*[docs.schema[c] for c in kept], StructField("fp", LongType())]))
    return found.select(*untuck(docs, given, "text"), "fp")


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Tree:
    """Top of a vantage-point tree over 32-bit halves: inner nodes (vantage point, boundary) in heap order, leaves are shards."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int):
        rng = np.random.default_rng(seed)
        self.depth = max(0, int(leaves - 1).bit_length())
        self.nodes: list[tuple[int, int]] = []
        level = [sample]
        for _ in range(self.depth):
            following = []
            for members in level:
                point = members[rng.integers(len(members))] if len(members) else np.uint64(rng.integers(1 << 32))
                d = distance(members, point)
                boundary = int(np.median(d)) if len(d) else 16
                if len(d) and (d <= boundary).all():        # many at one distance: cut below it
                    boundary -= 1
                self.nodes.append((int(point), boundary))
                following += [members[d <= boundary], members[d > boundary]]
            level = following

    def route(self, half: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, at home) of every shard that the ball around each half overlaps."""
        row, home, first = np.arange(len(half)), np.ones(len(half), bool), 0
        shard = np.zeros(len(half), np.int64)
        for level in range(self.depth):
            points = np.array([p for p, _ in self.nodes[first:first + (1 << level)]], np.uint64)
            bounds = np.array([b for _, b in self.nodes[first:first + (1 << level)]], np.int64)
            d, bound = distance(half[row], points[shard]).astype(np.int64), bounds[shard]
            inside, left, right = d <= bound, d - radius <= bound, d + radius > bound
            row = np.concatenate([row[left], row[right]])
            home = np.concatenate([(home & inside)[left], (home & ~inside)[right]])
            shard = np.concatenate([2 * shard[left], 2 * shard[right] + 1])
            first += 1 << level
        return row, shard, home


def link_near(fps: np.ndarray, home: np.ndarray, shift: int, bits: int, label: np.ndarray) -> None:
    """Merge in `label` the sets of all fps[i] and fps[j], j at home, that differ in at most `bits` bits and in at
    most bits // 2 of the half at `shift`: a vantage-point tree walked for all queries at once, in blocks."""
    half, radius, rng = fps >> np.uint64(shift) & HALF, bits // 2, np.random.default_rng(shift)
    work = [(np.flatnonzero(home), np.arange(len(fps)), 0)]
    while work:
        mine, queries, tried = work.pop()
        if not len(mine) or not len(queries):
            continue
        if len(mine) > 256 and tried < 3:
            point = half[mine[rng.integers(len(mine))]]
            d, q = distance(half[mine], point).astype(np.int64), distance(half[queries], point).astype(np.int64)
            boundary = int(np.median(d))
            if (d <= boundary).all():
                boundary -= 1
            inside = d <= boundary
            uneven = min(inside.sum(), len(d) - inside.sum()) < len(d) // 8
            work.append((mine[inside], queries[q - radius <= boundary], tried + 1 if uneven else 0))
            work.append((mine[~inside], queries[q + radius > boundary], tried + 1 if uneven else 0))
            continue
        for at in range(0, len(mine), 1 << 14):
            block = mine[at:at + (1 << 14)]
            rows = max(1, (1 << 20) // len(block))
            for i in range(0, len(queries), rows):
                some = queries[i:i + rows]
                a, b = np.nonzero(np.bitwise_count(fps[some][:, None] ^ fps[block][None, :]) <= bits)
                a, b = some[a], block[b]
                apart = label[a] != label[b]
                if apart.any():
                    merge(label, a[apart], b[apart])


def near_links(fps: DataFrame, bits: int = 3, shard_size: int = 2000, sample_size: int = 1 << 15) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that join exactly those which a chain of pairs within
    `bits` bits joins: within each shard the chains are merged, and only member and smallest member are emitted.

    The trees are made from the `sample_size` fingerprints with the smallest hash. A shard with more than
    `shard_size` * 8 home members (they agree in a half) is cut into blocks of that size, compared block by block."""
    spark, limit = fps.sparkSession, shard_size * 8
    n = fps.count()
    sample = np.array([r.fp for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(sample_size).collect()], np.int64).view(np.uint64)
    leaves = min(max(1, -(-n // shard_size)), max(1, sample_size // 8))
    trees = {shift: Tree(np.unique(sample >> np.uint64(shift) & HALF), leaves, shift) for shift in (0, 32)}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fp").to_numpy(zero_copy_only=False)
            for shift, tree in trees.items():
                row, shard, home = tree.route(own.view(np.uint64) >> np.uint64(shift) & HALF, bits // 2)
                yield pa.RecordBatch.from_arrays([pa.array(shard * 64 + shift), pa.array(own[row]), pa.array(home)], ["shard", "fp", "home"])

    routed = table(fps.select("fp").mapInArrow(route, "shard long, fp long, home boolean"), "routed")
    # One row per shard at most, and only of shards that are too large.
    sizes = routed.groupBy("shard").agg(F.sum(F.col("home").cast("long")).alias("mine"), F.count(F.lit(1)).alias("all"))
    large = {r.shard: (-(-r.mine // limit), -(-r["all"] // (4 * limit))) for r in sizes.filter((F.col("mine") > limit) | (F.col("all") > 4 * limit)).collect()}
    if large:
        cut = spark.createDataFrame([(s, int(m), int(q)) for s, (m, q) in large.items()], "shard long, mines int, asks int")
        routed_all = routed.join(F.broadcast(cut), "shard", "left")     # at most one row per shard of the trees
        one = routed_all.select("shard", "fp", "home", F.coalesce("mines", F.lit(1)).alias("mines"), F.coalesce("asks", F.lit(1)).alias("asks"))
        own_mine, own_ask = F.pmod(F.xxhash64("fp"), F.col("mines")), F.pmod(F.xxhash64(F.lit(1), "fp"), F.col("asks"))
        grid = F.transform(F.sequence(F.lit(0), F.col("mines") * F.col("asks") - 1), lambda k: F.struct(
            k.alias("cell"),
            (F.col("home") & (F.floor(k / F.col("asks")) == own_mine)).alias("at_home"), (k % F.col("asks") == own_ask).alias("asking")))
        cells = one.select("shard", "fp", F.explode(F.filter(grid, lambda g: g["at_home"] | g["asking"])).alias("g")).select(
            "shard", "g.cell", "fp", F.col("g.at_home").alias("home"))
    else:
        cells = routed.select("shard", F.lit(0).alias("cell"), "fp", "home")

    def shard_links(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # Sorted, so that the smallest index of a set is its smallest fingerprint.
        rows = rows.groupby("fp", sort=True).home.any()
        signed = rows.index.to_numpy(np.int64)
        label = np.arange(len(signed))
        link_near(signed.view(np.uint64), rows.to_numpy(bool), int(key[0]) % 64, bits, label)
        merge(label, label, label)
        linked = label != np.arange(len(label))
        return pd.DataFrame({"a": signed[label[linked]], "b": signed[linked]})

    return cells.groupBy("shard", "cell").applyInPandas(shard_links, "a long, b long")


def near_texts(docs: DataFrame, width: int, similarity: float, recall: float = 0.99) -> DataFrame:
    """Links (a, b) between the fingerprints of texts (column text) whose sets of five-word shingles reach the Jaccard
    similarity: MinHash bands tuned for recall name pairs, exact sets decide. Texts of fewer words take no part."""
    bands = tune(similarity, recall)
    docs = docs.filter("text is not null").select("text", F.xxhash64("text").alias("_tie"))

    def whole(texts: list[bytes]):
        return units_of([b" ".join(t.split()) for t in texts], 1 << 62)[0]      # one unit per text with a word

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for lo, hi in slices(column, 1 << 20):
                texts = byte_texts(column.slice(lo, hi - lo))
                units, fp = whole(texts), text_fingerprints(texts, width)
                some, values = signatures(units, bands)
                at = units.text[some]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_tie").take(pa.array(lo + at)), pa.array(fp[at].view(np.int64)), pa.array(units.content[some].view(np.int64)),
                     *[pa.array(v.view(np.int64)) for v in values]], ["_tie", "fp", "content", *[f"s{k}" for k in range(bands)]])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for lo, hi in slices(column, 1 << 20):
                units = whole(byte_texts(column.slice(lo, hi - lo)))
                some = np.flatnonzero(units.count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(units.content[some].view(np.int64)),
                     pa.array([np.unique(units.shingles[units.first[u]:units.first[u] + units.count[u]]).tobytes() for u in some.tolist()], pa.binary())],
                    ["content", "shingles"])

    signed = docs.mapInArrow(sign, "_tie long, fp long, content long, " + ", ".join(f"s{k} long" for k in range(bands)))
    # Equal texts meet in one row per task; texts of the same words have one fingerprint.
    units = table(signed.groupBy("content").agg(F.min("_tie").alias("_tie"), *[F.first(c).alias(c) for c in ["fp", *[f"s{k}" for k in range(bands)]]]), "texts")
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.col(f"s{k}").alias("value")) for k in range(bands)]))
    rows = units.select("content", values.alias("v")).select("content", "v.band", "v.value")
    several = table(rows.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "several")
    candidates = table(rows.join(several, ["band", "value"]), "text-candidates")
    wanted = table(units.join(candidates.select("content").distinct(), "content").select("_tie"), "wanted")
    # One of each: many rows may hold one text.
    chosen = docs.join(wanted, "_tie", "left_semi").mapInArrow(shingles, "content long, shingles binary")
    sets = table(chosen.groupBy("content").agg(F.first("shingles").alias("shingles")), "text-sets")
    links = near_sets(candidates, sets, similarity)
    fp = units.select("content", "fp")
    out = table(links.join(fp.toDF("a", "fa"), "a").join(fp.toDF("b", "fb"), "b").select(F.col("fa").alias("a"), F.col("fb").alias("b")), "text-links")
    drop(units, several, candidates, wanted, sets)
    return out


def grouped(docs: DataFrame, bits: int = 3, width: int = 3, similarity: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Written tables: rows (the columns of `docs` without text, and fp, a signed long) and groups (fp, label: the same
    for fingerprints that a chain of pairs within `bits` bits, or of texts of `similarity`, joins). Rows of one fingerprint meet in one row per
    task before any shuffle: fingerprints, not documents, are compared."""
    rows = table(fingerprints(docs, width=width), "fingerprints")
    distinct = table(rows.select("fp").distinct(), "distinct")
    links = near_links(distinct, bits)
    found = components(links if similarity is None else links.unionByName(near_texts(docs, width, similarity)))
    groups = table(distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label")), "groups")
    drop(found, distinct)
    return rows, groups


def near_duplicates(docs: DataFrame, bits: int = 3, width: int = 3) -> DataFrame:
    """doc_id, fp (signed long) and component_id of every row of `docs` (doc_id, text): the smallest doc_id in its group,
    its own included. Rows without a doc_id take part, but give no component_id: it is null where no member has one."""
    rows, groups = grouped(docs.select("doc_id", "text"), bits, width)
    firsts = table(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    lowest = table(groups.join(firsts, "fp").groupBy("label").agg(F.min("first").alias("component_id")), "lowest")
    ids = table(groups.join(lowest, "label").select("fp", "component_id"), "ids")
    drop(groups, firsts, lowest)
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, bits: int = 3, width: int = 3, similarity: float | None = None) -> DataFrame:
    """The rows of `docs` (doc_id, text, other columns) without near-duplicates, which are those within `bits` bits and, if
    given, those whose five-word shingles have the Jaccard `similarity`: of each group the row with the smallest
    doc_id stays (null last; of one id the one with the smallest text hash; of rows equal in both any one)."""
    given, docs = docs, tuck(docs, "doc_id", "text")
    mark = [F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("_doc"), F.xxhash64("text").alias("_tie")]
    rows, groups = grouped(docs.select(*mark, "text"), bits, width, similarity)
    alike = rows.groupBy("fp", "_doc", "_tie").agg(F.count(F.lit(1)).alias("n"))
    best = table(alike.groupBy("fp").agg(F.min(F.struct("_doc", "_tie", "n")).alias("best")), "best")
    chosen = table(best.join(groups, "fp").groupBy("label").agg(F.min("best").alias("best")).select("best.*"), "chosen")
    drop(rows, groups, best)
    kept = docs.select("*", *mark).join(chosen, ["_doc", "_tie"])
    if chosen.filter("n > 1").isEmpty():
        return kept.select(untuck(docs, given))
    repeated = kept.filter("n > 1").dropDuplicates(["_doc", "_tie"])
    return kept.filter("n = 1").unionByName(repeated).select(untuck(docs, given))


def hexadecimal(fp: Column | str) -> Column:
    """16 lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, F.lit("0")))
