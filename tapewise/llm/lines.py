"""Line dedup by overlapping windows of three lines, in DataFrame functions only.

Each line is hashed once; a window is the hash of three consecutive lines that hold a word. Windows found before,
earlier in the same text or in a document with a smaller id, are repeats: the positions that they cover are merged,
and these lines go. Every distinct line of a repeat stays where it came first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, table, tuck, untuck

LAST = (1 << 63) - 1        # stands for a null doc_id in comparisons


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, keys: list[Column], width: int = 3) -> DataFrame:
    """(keys, w1, w2, first, last, again): one row per window of `width` consecutive lines with a word: 128 bits of its
    lines, the positions of the first and the last among all lines of the text, and whether an earlier window of the
    text is equal. In steps, each of which later ones use more than once: so each is computed once."""
    hashed = F.transform(lines_of(F.col("text")), lambda line, i: F.struct(
        i.alias("i"), line.rlike(r"[^\x20\x09-\x0D]").alias("full"), F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")))
    df = docs.select(*keys, F.filter(hashed, lambda x: x["full"]).alias("_lines"))
    count = F.greatest(F.size("_lines") - (width - 1), F.lit(0))
    chain = F.transform(F.slice("_lines", F.lit(1), count), lambda x: F.struct(
        x["h1"].alias("w1"), x["h2"].alias("w2"), x["i"].alias("first"), x["i"].alias("last")))
    for k in range(1, width):       # each chain grows by the line that follows it
        chain = F.zip_with(chain, F.slice("_lines", F.lit(k + 1), count), lambda c, x: F.struct(
            F.xxhash64(c["w1"], x["h1"]).alias("w1"), F.xxhash64(c["w2"], x["h2"]).alias("w2"), c["first"].alias("first"), x["i"].alias("last")))
    names = [c for c in df.columns if c != "_lines"]
    df = df.select(*names, F.sort_array(chain).alias("_chain"))
    before = F.slice(F.concat(F.slice("_chain", 1, 1), F.col("_chain")), F.lit(1), F.size("_chain"))
    marked = F.zip_with("_chain", before, lambda c, p: F.struct(
        c["w1"].alias("w1"), c["w2"].alias("w2"), c["first"].alias("first"), c["last"].alias("last"),
        ((c["w1"] == p["w1"]) & (c["w2"] == p["w2"]) & (c["first"] != p["first"])).alias("again")))
    return df.select(*names, F.explode(marked).alias("w")).select(*names, "w.*")


def remove_repeats(docs: DataFrame, width: int = 3) -> DataFrame:
    """`docs` (doc_id, text, other columns) with the repeated lines taken out of text, and n_lines and n_removed
    (columns of these names are replaced).

    Documents with fewer than `width` lines with a word stay as they are; a null text stays null and has no lines. Lines
    without a word belong to no window; between two lines of a repeat they go with it. Documents come in the order of doc_id,
    those with the same one, or with none (after all others), in the order of their text's hash; rows that are equal in
    both count as one place: they are no repeats of each other."""
    given = docs.drop("n_lines", "n_removed")
    docs = tuck(given, "doc_id", "text")
    mark = [F.coalesce("doc_id", F.lit(LAST)).alias("_doc"), F.xxhash64("text").alias("_tie")]
    found = table(windows(docs, mark, width), "windows")
    place = F.struct("_doc", "_tie")
    # One row per window and task before the shuffle, whatever repeats how often.
    repeated = table(found.filter(~F.col("again")).groupBy("w1", "w2").agg(F.min(place).alias("origin"), F.max(place).alias("latest"))
                     .filter("origin < latest").select("w1", "w2", "origin"), "repeated")
    # Both sides are tables: adaptive execution splits a window that many documents share.
    later = found.filter(~F.col("again")).join(repeated, ["w1", "w2"]).filter(place > F.col("origin")).select("_doc", "_tie", "first", "last")
    later = later.unionByName(found.filter("again").select("_doc", "_tie", "first", "last"))
    covered = table(later.groupBy("_doc", "_tie").agg(F.collect_set(F.struct("first", "last")).alias("_spans")), "covered")     # of one text
    drop(found, repeated)
    # Always by a shuffle: what is covered grows with the texts, so the plan is the same at every size.
    rows = docs.select("*", *mark).join(covered.hint("merge"), ["_doc", "_tie"], "left").drop("_doc", "_tie")
    gone = F.sort_array(F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(s["first"], s["last"])))))
    rows = rows.withColumn("_gone", F.when(F.col("_spans").isNotNull(), gone)).drop("_spans")
    lines, gone, n = lines_of(F.col("text")), F.col("_gone"), F.size("_gone")
    # For each removed position, the kept ones before it; then those after the last: one flag per line.
    since = F.concat(F.array(F.lit(-1)), gone)
    flags = F.concat(F.flatten(F.zip_with(gone, F.slice(since, F.lit(1), n), lambda at, before: F.concat(
        F.array_repeat(F.lit(True), (at - before - 1).cast("int")), F.array(F.lit(False))))),
        F.array_repeat(F.lit(True), (F.size(lines) - 1 - F.element_at(gone, -1)).cast("int")))
    kept = F.filter(F.zip_with(lines, flags, lambda line, stays: F.struct(line.alias("line"), stays.alias("stays"))), lambda x: x["stays"])
    text = F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    return rows.select(*[text.alias("text") if c == "text" else column for c, column in zip(given.columns, untuck(docs, given))],
                       F.coalesce(F.regexp_count("text", F.lit("\n")) + 1, F.lit(0)).cast("long").alias("n_lines"),
                       F.coalesce(n, F.lit(0)).cast("long").alias("n_removed"))
