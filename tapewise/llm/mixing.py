"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and bucket of a document hash. Per source, whole copies of everything are taken as long as
they fit its target; what is left picks the documents below a hash threshold. The bucket in which the running sum
passes that rest is found from the histogram, and only that bucket is refined, twelve bits of the hash at a time, down
to one hash value. Applying the thresholds is a filter: nothing is sorted, and thresholds of smaller targets select
subsets of what larger ones select."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, n_words, table, tuck, untuck

BITS, LEVELS = 12, 5        # of a hash of 60 bits


def document_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the md5 of id and text, as a long: the same in any engine. Rows equal in both are taken together."""
    md5 = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(md5, 1, 15), 16, 10).cast("long")


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Adds the position of each row in `order`, from 0: a range sort, and one count per range."""
    n_low = 33      # monotonically_increasing_id: the partition above, the row in it below
    rows = table(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", n_low)
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))      # a row per range
    starts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return (rows.withColumn("_part", part).join(starts, "_part")
            .withColumn(name, F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << n_low) - 1))).drop("_id", "_part", "_start"))


def share_out(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """Adds `target` to sources (source_size, weight): `share` times all sizes, dealt by weight; no target passes `cap`
    times its source's size, and the excess is dealt again by weight among the others until none is above.

    Each round is one small aggregate and caps at least one more source; two numbers come to the driver."""
    limit, total = F.col("source_size") * F.lit(float(cap)), sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, -1
    while True:
        over = F.lit(False) if level is None else limit < F.col("weight") * F.lit(level)
        row = sources.agg(F.sum(F.when(over, limit)).alias("taken"), F.sum(F.when(~over, F.col("weight"))).alias("weights"),
                          F.count_if(over).alias("capped")).first()
        if not row["weights"]:
            return sources.withColumn("target", limit)
        if row["capped"] == capped:
            return sources.withColumn("target", F.least(limit, F.col("weight") * F.lit(level)))
        level, capped = (share * total - (row["taken"] or 0.0)) / row["weights"], row["capped"]


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Written table of targets (key, source_size, target) with `copies` (whole copies of every document) and `below`
    (documents whose hash is below it get one more), from sized (key, size, hash). What is taken is as near the
    target as a threshold can bring it; of two equally near ones the lower."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    wanted = table(targets.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")), "wanted")
    open_, done = wanted.select("key", "rest", F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("prefix")), []
    by = Window.partitionBy("key").orderBy("bucket")        # 4096 buckets at most
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = sized.join(open_, "key").filter(F.shiftright("hash", shift + BITS) == F.col("prefix"))
        histogram = inside.groupBy("key", "rest", "base", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("s"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        running = histogram.withColumn("upto", F.col("base") + F.sum("s").over(by))
        crossing = (running.filter(F.col("upto") > F.col("rest")).groupBy("key", "rest")
                    .agg(F.min_by(F.struct("bucket", "s", "upto", "lo", "hi"), "bucket").alias("c")).select("key", "rest", "c.*"))
        found = table(crossing.withColumn("before", F.col("upto") - F.col("s")), "crossing")
        one = F.col("lo") == F.col("hi")
        nearer = F.col("upto") - F.col("rest") < F.col("rest") - F.col("before")
        done.append(found.filter(one).select("key", (F.col("lo") + F.when(nearer, 1).otherwise(0)).alias("below")))
        open_ = found.filter(~one).select("key", "rest", F.col("before").alias("base"), F.col("bucket").alias("prefix"))
        if open_.isEmpty():
            break
    below = done[0]
    for more in done[1:]:
        below = below.unionByName(more)
    # A source whose rest is zero takes none, and none of its buckets passes a rest that all of it fits.
    out = table(wanted.join(below, "key", "left").withColumn("below", F.coalesce("below", F.lit(0))), "thresholds")
    drop(wanted)
    return out


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """`docs` (doc_id, text, source, other columns) with size (words), source_size, target (of the source) and copies:
    how often the mix takes the document. Columns of those names are replaced.

    Sources in code point order, null last, have `weights`, repeating. A source of size 0 has the target 0. Rows equal in
    id and text share a hash, so they are taken alike."""
    own = ["size", "source_size", "target", "copies"]
    docs = docs.drop(*own)
    rows = tuck(docs, "doc_id", "text", "source")
    named = rows.select("*", *measured(rows))
    sized = table(named.select("_key", "size", "_hash"), "sizes")
    mixed = apply_mix(named, mix_table(sized, weights, share, cap))
    return mixed.select(*untuck(rows, docs), *own)


def measured(docs: DataFrame) -> list[Column]:
    """_key (of the source, never null: the letter keeps a null source apart from any name), size and _hash."""
    return [F.coalesce(F.concat(F.lit("s"), docs["source"]), F.lit("n")).alias("_key"), n_words(docs["text"]).alias("size"),
            document_hash(docs["doc_id"], docs["text"]).alias("_hash")]


def mix_table(sized: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Thresholds of the sources in sized (_key, size, _hash)."""
    sized = sized.withColumnsRenamed({"_key": "key", "_hash": "hash"})
    sizes = table(sized.groupBy("key").agg(F.sum("size").alias("source_size")), "sources")
    # "n" < "s": the null key goes last.
    ranked = numbered(sizes, [(F.col("key") == "n"), F.col("key")], "position")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    sources = table(ranked.select("key", "source_size", weight.alias("weight")), "sources")
    return thresholds(sized, share_out(sources, share, cap))


def apply_mix(named: DataFrame, limits: DataFrame) -> DataFrame:
    """Documents with _key, size and _hash, joined to their source's row: no shuffle while the sources are few, else a
    join whose large sources adaptive execution splits."""
    limits = limits.select(F.col("key").alias("_key"), "source_size", "target", F.col("copies").alias("_whole"), F.col("below").alias("_below"))
    copies = F.col("_whole") + F.when(F.col("_hash") < F.col("_below"), 1).otherwise(0)
    return named.join(limits, "_key").withColumn("copies", copies).drop("_key", "_hash", "_whole", "_below")
