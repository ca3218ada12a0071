"""Substring dedup by paragraphs: MinHash banding, exact verification, components.

A paragraph is a line; a line of more than LONGEST words is cut further where the hash of three words is the lowest
among REACH neighbours on either side. Such cuts depend on the words around them alone, so a passage that was pasted
into other text falls into the same paragraphs there, but for its ends. A line that is cut can be compared as a whole
too, so that a change inside it does not hide a repeat. What is compared is the set of five-word shingles. Bands of MinHash
values, tuned for recall, name candidates; candidates are verified by the exact Jaccard similarity of their sets; equal
and linked ones make components. Of the lines of a component only the first stays; of the paragraphs that are left by
then, again only the first of each component. What so repeats goes if the passage around it is long enough: paragraphs side by side
are one run, which is followed word by word into its neighbours as far as text and origin agree."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import byte_texts, drop, slices, table, tuck, untuck
from .graph import components, merge
from .tokens import LENGTH_MIX, POWERS, VALUES

LONGEST, REACH, SHINGLE = 24, 6, 5
LAST = (1 << 63) - 1        # stands for a null doc_id in comparisons
INK = np.array([b not in (9, 10, 11, 12, 13, 32) for b in range(256)])


def tune(similarity: float, recall: float = 0.99) -> int:
    """Bands of one MinHash value each that find a pair of `similarity` with at least `recall`. A band of one value
    needs the fewest bands, so the fewest rows, for a recall; what else it names is sorted out by verification."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity)))


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit integers that spreads them."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@dataclass
class Units:
    """Paragraphs of some texts, in order."""
    text: np.ndarray        # which text
    place: np.ndarray       # its place there, from 0
    words: np.ndarray
    begin: np.ndarray       # bytes in the joined buffer, from the first word's first ...
    end: np.ndarray         # ... to the last word's end
    line: np.ndarray        # line number in the buffer
    content: np.ndarray     # hash of all words
    shingles: np.ndarray    # hashes of five words, of all paragraphs with so many
    first: np.ndarray       # of each paragraph, its first in `shingles`
    count: np.ndarray       # and how many


def paragraphs(texts: list[bytes]) -> Units:
    """Words are what ASCII white space separates, A-Z lower-cased."""
    return units_of(texts)[0]


NONE = Units(*[np.empty(0, t) for t in (int, int, int, int, int, int, np.uint64, np.uint64, int, int)])


def runs(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers begin[i], begin[i] + 1, ..., `size[i]` of them, one run after the other; and their places in the runs."""
    ramp = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(begin, size) + ramp, ramp


@dataclass
class Lines:
    """Lines of several paragraphs, each as one unit whose place is that of its first paragraph."""
    units: Units
    span: np.ndarray        # paragraphs of each
    head: np.ndarray        # of each paragraph of the texts, the place of its line's first
    part: np.ndarray        # and whether its line has others


def units_of(texts: list[bytes], longest: int = LONGEST) -> tuple[Units, Lines]:
    """(paragraphs, lines of several paragraphs); lines of up to `longest` words are not cut."""
    raw = np.frombuffer(b"\n" + b"\n".join(texts).lower() + b"\n", np.uint8)
    inside = INK[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, stops = edges[0::2], edges[1::2]
    n = len(starts)
    if not n:
        return NONE, Lines(NONE, NONE.place, NONE.place, NONE.place.astype(bool))
    span, offsets = raw[starts[0]:stops[-1]], starts - starts[0]
    at = np.arange(len(span)) - np.repeat(offsets, np.diff(np.append(offsets, len(span))))
    terms = np.where(inside[starts[0]:stops[-1]], VALUES[span] * POWERS[at % (len(POWERS) - 1)], np.uint64(0))
    word = mixed(np.add.reduceat(terms, offsets) + (stops - starts).astype(np.uint64) * LENGTH_MIX)
    lines = np.flatnonzero(raw == 10)
    line = np.searchsorted(lines, starts) - 1
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts - 1, side="right")
    opens = np.concatenate([[True], line[1:] != line[:-1]])
    # Lowest of the neighbourhood: lower than those before, not higher than those after; other texts do not count.
    ahead, whose = np.concatenate([word, np.zeros(REACH, np.uint64)]), np.concatenate([np.full(REACH, -1), owner, np.full(REACH, -1)])
    value = word * np.uint64(3)
    for k, factor in ((1, 5), (2, 7)):
        value = value + np.where(whose[REACH + k:REACH + k + n] == owner, ahead[k:k + n], np.uint64(0)) * np.uint64(factor)
    value = mixed(value)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    padded = np.concatenate([np.full(REACH, top), value, np.full(REACH, top)])
    lowest = np.ones(n, bool)
    for k in range(1, REACH + 1):
        before, after = slice(REACH - k, REACH - k + n), slice(REACH + k, REACH + k + n)
        lowest &= ((value < padded[before]) | (whose[before] != owner)) & ((value <= padded[after]) | (whose[after] != owner))
    first_of_line = np.flatnonzero(opens)
    long = np.repeat(np.diff(np.append(first_of_line, n)) > longest, np.diff(np.append(first_of_line, n)))
    begin = np.flatnonzero(opens | lowest & long)
    size = np.diff(np.append(begin, n))
    text = owner[begin]
    place = np.arange(len(begin)) - np.searchsorted(text, text)
    shingle = np.zeros(max(0, n - SHINGLE + 1), np.uint64)      # from every word on
    for k in range(SHINGLE):
        shingle = mixed(shingle + word[k:k + len(shingle)] + np.uint64(k))

    def made(begin: np.ndarray, size: np.ndarray, place: np.ndarray) -> Units:
        # Sum of word hash * power of the place: equal words in equal places.
        at, ramp = runs(begin, size)
        content = np.add.reduceat(mixed(word[at] + ramp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.cumsum(size) - size)
        count = np.maximum(size - SHINGLE + 1, 0)
        return Units(owner[begin], place, size, starts[begin], stops[begin + size - 1], line[begin], mixed(content + size.astype(np.uint64)),
                     shingle[runs(begin, count)[0]], np.cumsum(count) - count, count)

    heads = np.flatnonzero(opens[begin])        # paragraphs that begin a line
    span = np.diff(np.append(heads, len(begin)))
    several = heads[span > 1]
    whole = made(begin[several], np.diff(np.append(begin[heads], n))[span > 1], place[several]) if len(several) else NONE
    return made(begin, size, place), Lines(whole, span[span > 1], np.repeat(place[heads], span), np.repeat(span > 1, span))


def signatures(units: Units, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """(compared paragraphs, their MinHash values by band)."""
    some = np.flatnonzero(units.count)
    if not len(some):
        return some, np.empty((bands, 0), np.uint64)
    return some, np.stack([np.minimum.reduceat(mixed(units.shingles ^ VALUES[k]), units.first[some]) for k in range(bands)])


def overlap(home: list[np.ndarray], asking: list[np.ndarray]) -> np.ndarray:
    """(asking x home) sizes of the intersections of sets, by the inverted lists of the home sets."""
    token, row = np.concatenate(home), np.repeat(np.arange(len(home)), [len(h) for h in home])
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    flat, query = np.concatenate(asking), np.repeat(np.arange(len(asking)), [len(a) for a in asking])
    lo, hi = np.searchsorted(token, flat, "left"), np.searchsorted(token, flat, "right")
    size = hi - lo
    at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return np.bincount(np.repeat(query, size) * len(home) + row[at], minlength=len(asking) * len(home)).reshape(len(asking), len(home))


def unit_table(docs: DataFrame, bands: int, whole_lines: bool) -> DataFrame:
    """Written table of compared paragraphs and lines: _doc, _tie (the row of docs), place, head (the place of its line's first
    paragraph), span (paragraphs of a line, 0 for a part of one), words, content and one MinHash value per band."""
    names = [f"s{k}" for k in range(bands)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for lo, hi in slices(text, 1 << 20):
                pieces, lines = units_of(byte_texts(text.slice(lo, hi - lo)))
                kinds = [(pieces, lines.head, np.where(lines.part, 0, 1)), (lines.units, lines.units.place, lines.span)]
                for units, head, span in kinds if whole_lines else kinds[:1]:
                    some, values = signatures(units, bands)
                    rows = pa.array(lo + units.text[some])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("_doc").take(rows), batch.column("_tie").take(rows), *[pa.array(x[some].astype(np.int32)) for x in (units.place, head, span, units.words)],
                         pa.array(units.content[some].view(np.int64)), *[pa.array(v.view(np.int64)) for v in values]],
                        ["_doc", "_tie", "place", "head", "span", "words", "content", *names])

    return table(docs.select("_doc", "_tie", "text").mapInArrow(
        run, "_doc long, _tie long, place int, head int, span int, words int, content long, " + ", ".join(f"{s} long" for s in names)), "units")


def shingle_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(content, shingles) of the paragraphs and lines in wanted (_doc, _tie, place, span)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for lo, hi in slices(text, 1 << 20):
                pieces, lines = units_of(byte_texts(text.slice(lo, hi - lo)))
                for units, column in ((pieces, "places"), (lines.units, "lines")):
                    places = batch.column(column).slice(lo, hi - lo).to_pylist()
                    at = {(t, p): u for u, (t, p) in enumerate(zip(units.text.tolist(), units.place.tolist()))}
                    some = np.array([at[i, p] for i, chosen in enumerate(places) for p in chosen], np.int64)
                    # Bounded batches: the sets of long lines are as long as their texts.
                    sizes = np.cumsum(units.count[some])
                    for part in np.split(some, np.searchsorted(sizes, np.arange(1 << 20, int(sizes[-1]), 1 << 20)) if len(sizes) else []):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(units.content[part].view(np.int64)),
                             pa.array([np.unique(units.shingles[units.first[u]:units.first[u] + units.count[u]]).tobytes() for u in part.tolist()], pa.binary())],
                            ["content", "shingles"])

    rows = wanted.groupBy("_doc", "_tie").agg(F.collect_set(F.when(F.col("span") < 2, F.col("place"))).alias("places"),     # of one text
                                              F.collect_set(F.when(F.col("span") > 1, F.col("place"))).alias("lines"))
    return docs.select("_doc", "_tie", "text").join(rows, ["_doc", "_tie"]).select("text", "places", "lines").mapInArrow(run, "content long, shingles binary")


def pair_overlaps(keys: np.ndarray, base: int, tokens: np.ndarray, first: np.ndarray, count: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a[i] and b[i]; keys: sorted set * base + token of all sets."""
    size = count[a]
    begin = np.cumsum(size) - size
    wanted = np.repeat(b, size) * base + tokens[np.repeat(first[a] - begin, size) + np.arange(int(size.sum()))]
    hit = keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted
    return np.add.reduceat(hit, begin, dtype=np.int64)


def near_links(candidates: DataFrame, sets: DataFrame, similarity: float, cell: int = 1024, bucket: int = 4096) -> DataFrame:
    """Links (a, b) of contents in candidates (band, value, content; distinct) whose sets reach `similarity`: the same
    components as all such pairs have. A long list of a value is cut into a grid of cells, blocks by blocks; a task takes
    buckets of about `bucket` rows or 4 MB, cells and short lists together. Pairs that are linked already are left out."""
    key = ["band", "value"]
    lists = candidates.join(sets, "content")
    sizes = table(candidates.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("blocks")), "lists")
    block = F.pmod(F.xxhash64("content"), "blocks").cast("int")
    # Block i meets block j in cell (smaller, larger).
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, block).alias("lo"), F.greatest(j, block).alias("hi")))
    placed = lists.join(sizes, key).select(*key, "content", "shingles", block.alias("block"), F.explode(cells).alias("c")).select("*", "c.lo", "c.hi").drop("c")
    held = sets.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("shingles")).alias("bytes")).first()
    n = candidates.count()
    buckets = max(1, n // bucket, n * (held["bytes"] or 0) // max(1, held["n"]) // (1 << 22))
    where = F.pmod(F.xxhash64(*key, "lo", "hi"), F.lit(buckets)).alias("bucket")

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*key, "lo", "hi", "content"])
        ids, at, own = np.unique(rows.content.to_numpy(), return_index=True, return_inverse=True)
        sets = [np.frombuffer(s, np.uint64) for s in rows.shingles.iloc[at]]
        count = np.array([len(s) for s in sets])
        first = np.cumsum(count) - count
        base, tokens = np.unique(np.concatenate(sets), return_inverse=True)
        keys = np.sort(np.repeat(np.arange(len(ids)), count) * len(base) + tokens)
        label = np.arange(len(ids))

        def judge(a: np.ndarray, b: np.ndarray, both: np.ndarray) -> None:
            near = both >= similarity * (count[a] + count[b] - both) - 1e-9
            merge(label, a[near], b[near])

        place = rows[[*key, "lo", "hi"]].to_numpy()
        begin = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]).any(axis=1)]))
        size = np.diff(np.append(begin, len(rows)))
        lo, hi, block = rows.lo.to_numpy(), rows.hi.to_numpy(), rows.block.to_numpy()
        short = (size <= 64) & (lo[begin] == hi[begin])
        # Short lists: each row with those before it in its list.
        rank = np.where(np.repeat(short, size), np.arange(len(rows)) - np.repeat(begin, size), 0)
        upto = np.cumsum(rank * count[own])
        i = 0
        while i < len(rows):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + 3_000_000, side="right")))
            n = rank[i:j]
            a = np.repeat(np.arange(i, j), n)
            b = np.repeat(np.arange(i, j) - n - (np.cumsum(n) - n), n) + np.arange(len(a))
            if len(a):
                judge(own[a], own[b], pair_overlaps(keys, len(base), tokens, first, count, own[a], own[b]))
            i = j
        for k in np.flatnonzero(~short).tolist():
            part = slice(begin[k], begin[k] + size[k])
            home, asking = own[part][block[part] == lo[begin[k]]], own[part][block[part] == hi[begin[k]]]
            if not len(home) or not len(asking):
                continue
            for x in home[:4]:      # in a large group of near copies these link almost all
                for y in np.array_split(asking, 1 + int(count[x]) * len(asking) // 3_000_000):
                    judge(np.full(len(y), x), y, pair_overlaps(keys, len(base), tokens, first, count, np.full(len(y), x), y))
            names, often = np.unique(label[home], return_counts=True)
            most = names[often.argmax()]
            for ours, theirs in ((home[label[home] != most], asking[label[asking] == most]), (home, asking[label[asking] != most])):
                step = max(1, min(128, 4_000_000 // max(1, int(count[ours].sum()))))
                for i in range(0, len(theirs) if len(ours) else 0, step):
                    some = theirs[i:i + step]
                    both = overlap([sets[h] for h in ours], [sets[x] for x in some])
                    a, b = np.nonzero(both)
                    judge(some[a], ours[b], both[a, b])
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"a": ids[label[linked]], "b": ids[linked]})

    return placed.select("*", where).groupBy("bucket").applyInPandas(verify, "a long, b long")


def surroundings(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """Written table (_doc, _tie, place, after, near) for the rows of wanted (without near): hashes of up to `least` words after, or
    before, the paragraph at a place, nearest first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, asked = batch.column("text"), batch.column("asked").to_pylist()
            for lo, hi in slices(text, 1 << 20):
                raw = byte_texts(text.slice(lo, hi - lo))
                units = paragraphs(raw)
                begin = np.searchsorted(units.text, np.arange(hi - lo + 1))
                rows, place, after, near = [], [], [], []
                for i in range(hi - lo):
                    words = raw[i].lower().split()
                    starts = np.concatenate([[0], np.cumsum(units.words[begin[i]:begin[i + 1]])])
                    for a in asked[lo + i]:
                        at = int(starts[a["place"] + a["after"]])
                        some = words[at:at + least] if a["after"] else words[max(0, at - least):at][::-1]
                        rows.append(lo + i)
                        place.append(a["place"])
                        after.append(a["after"])
                        near.append(np.array([zlib.crc32(w) for w in some], np.uint32).view(np.int32))
                rows = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_doc").take(rows), batch.column("_tie").take(rows), pa.array(place, pa.int32()), pa.array(after, pa.bool_()), pa.array(near, pa.list_(pa.int32()))],
                    ["_doc", "_tie", "place", "after", "near"])

    key = ["_doc", "_tie", "place", "after"]
    rows = wanted.groupBy("_doc", "_tie").agg(F.collect_set(F.struct("place", "after")).alias("asked"))     # of one text
    found = docs.select("_doc", "_tie", "text").join(rows, ["_doc", "_tie"]).select("_doc", "_tie", "text", "asked").mapInArrow(
        run, "_doc long, _tie long, place int, after boolean, near array<int>")
    return table(found.groupBy(*key).agg(F.first("near").alias("near")), "surroundings")


def long_enough(docs: DataFrame, gone: DataFrame, least: int) -> DataFrame:
    """The rows of gone (_doc, _tie, head, span, words, o__doc, o__tie, o_place, o_span, other columns) that lie in a repeated passage of at
    least `least` words, or in one that is the whole text.

    Rows side by side are a run. A shorter run is followed backwards from its first row, and onwards from its last, as far as
    the words agree with those around that row's origin. All windows and lists are of one text."""
    text = Window.partitionBy("_doc", "_tie").orderBy("head")
    opens = F.coalesce(F.lag(F.col("head") + F.col("span")).over(text) != F.col("head"), F.lit(True))
    rows = table(gone.withColumn("_opens", opens.cast("int")).withColumn("_run", F.sum("_opens").over(text)).drop("_opens"), "gone")
    run = ["_doc", "_tie", "_run"]
    ends = rows.groupBy(*run).agg(
        F.sum("words").alias("words"), F.min(F.struct("head", "o__doc", "o__tie", "o_place")).alias("a"),
        F.max(F.struct("head", "span", "o__doc", "o__tie", "o_place", "o_span")).alias("b"))
    side = lambda after, place, of, o_place: F.struct(F.lit(after).alias("after"), place.cast("int").alias("place"), F.col(f"{of}.o__doc").alias("o__doc"),
                                                      F.col(f"{of}.o__tie").alias("o__tie"), o_place.cast("int").alias("o_place"))
    last, o_last = F.col("b.head") + F.col("b.span") - 1, F.col("b.o_place") + F.greatest(F.col("b.o_span"), F.lit(1)) - 1
    short = table(ends.filter(F.col("words") < least).select(*run, "words", F.explode(F.array(
        side(False, F.col("a.head"), "a", F.col("a.o_place")), side(True, last, "b", o_last))).alias("s")).select(*run, "words", "s.*"), "short-runs")
    origin = [F.col("o__doc").alias("_doc"), F.col("o__tie").alias("_tie"), F.col("o_place").alias("place"), "after"]
    words = surroundings(docs, short.select("_doc", "_tie", "place", "after").unionByName(short.select(*origin)).distinct(), least)
    theirs = words.select(F.col("_doc").alias("o__doc"), F.col("_tie").alias("o__tie"), F.col("place").alias("o_place"), "after", F.col("near").alias("o_near"))
    apart = F.array_position(F.zip_with("near", "o_near", lambda x, y: x.eqNullSafe(y)), False)
    same = F.when(apart == 0, F.size("near")).otherwise(apart - 1)
    stays = table(short.join(words, ["_doc", "_tie", "place", "after"]).join(theirs, ["o__doc", "o__tie", "o_place", "after"])
                  .groupBy(*run).agg(F.first("words").alias("words"), F.sum(same).alias("more"), F.sum(F.size("near")).alias("around"))
                  .filter((F.col("words") + F.col("more") < least) & (F.col("around") > 0)).select(*run), "short")
    drop(short, words)
    return rows.join(stays, run, "left_anti").drop("_run")


def cut_texts(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs (columns, text, gone: places or null) with the paragraphs in `gone` taken out of text, and n_paragraphs. What
    stays of a text that loses some keeps its paragraphs, with a line end between them where there was one, else a space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, gone = batch.column("text"), batch.column("gone").to_pylist()
            for lo, hi in slices(text, 1 << 20):
                raw = byte_texts(text.slice(lo, hi - lo))
                units, joined = paragraphs(raw), b"\n" + b"\n".join(raw)
                begin = np.searchsorted(units.text, np.arange(hi - lo + 1))
                out = text.slice(lo, hi - lo).to_pylist()
                for i in range(hi - lo):
                    if gone[lo + i]:
                        stays = np.setdiff1d(np.arange(begin[i], begin[i + 1]), begin[i] + np.array(gone[lo + i]))
                        pieces, line = [], None
                        for u in stays.tolist():
                            if line is not None:
                                pieces.append(b"\n" if units.line[u] != line else b" ")
                            pieces.append(joined[units.begin[u]:units.end[u]])
                            line = units.line[u]
                        out[i] = b"".join(pieces).decode()
                made = {c: batch.column(c).slice(lo, hi - lo) for c in columns}
                made |= {"text": pa.array(out, pa.string()), "n_paragraphs": pa.array(np.diff(begin).astype(np.int64))}
                yield pa.RecordBatch.from_arrays(list(made.values()), list(made))

    schema = StructType([*[docs.schema[c] for c in [*columns, "text"]], StructField("n_paragraphs", LongType())])
    return docs.select(*columns, "text", "gone").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, similarity: float = 0.8, recall: float = 0.99, whole_lines: bool = False, least: int = 0) -> DataFrame:
    """`docs` (doc_id, text, other columns) with repeated paragraphs taken out of text, and n_paragraphs, n_removed,
    words_removed and origins (sorted ids of the documents that hold what stays of them); columns of those names are
    replaced.

    Of equal and near-equal lines (with `whole_lines`; else lines of several paragraphs are compared by these only), and
    then of such paragraphs in what is left, the one stays whose document has the smallest doc_id (null last; rows of one
    id by text hash), the first in its text. A line goes with all its paragraphs; what it was first with does not count
    as a place for later ones. Paragraphs of fewer than five words are not compared
    by themselves. With `least`, only what lies in a repeated passage of so many words, in whatever paragraphs, or repeats a whole text, goes.
    A null text stays null. Rows equal in id and text are one document here: none of them is a repeat of
    the other.

    Contents are pre-aggregated before every shuffle, and only those that share a band's value with another paragraph
    go beyond counting; their sets are read again from their texts, not stored for all."""
    own = ["n_paragraphs", "n_removed", "words_removed", "origins"]
    given = docs.drop(*own)
    tucked = tuck(given, "doc_id", "text")
    docs = tucked.select("*", F.coalesce("doc_id", F.lit(LAST)).alias("_doc"), F.xxhash64("text").alias("_tie"))
    bands = tune(similarity, recall)
    units = unit_table(docs, bands, whole_lines)
    banded = lambda low: F.array(*[F.struct(F.lit(low + k).alias("band"), F.col(f"s{k}").alias("value")) for k in range(bands)])
    values = F.explode(banded(0))
    if whole_lines:
        # Paragraphs meet paragraphs, lines meet lines: each line shares values with its own parts. A line of one paragraph
        # is both, if it is long enough to be like one of several.
        enough = int(np.ceil(similarity * (LONGEST + 2 - SHINGLE) - 1e-9)) + SHINGLE - 1
        values = F.explode(F.when(F.col("span") > 1, banded(bands)).when((F.col("span") == 1) & (F.col("words") >= enough), F.concat(banded(0), banded(bands))).otherwise(banded(0)))
    shared = table(units.select(values.alias("v")).groupBy("v.band", "v.value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "shared")
    # Both sides are tables: adaptive execution splits a value that many paragraphs share.
    rows = units.select("content", values.alias("v")).select("content", "v.band", "v.value")
    found = table(rows.join(shared, ["band", "value"]).distinct(), "found")
    repeated = table(found.select("content").distinct(), "contents")
    occurrences = table(units.select("_doc", "_tie", "place", "head", "span", "words", "content").join(repeated, "content"), "occurrences")
    drop(units, shared)
    # Different contents under one value are candidates; one occurrence of each brings its set.
    several = found.groupBy("band", "value").agg(F.min("content").alias("lo"), F.max("content").alias("hi")).filter("lo < hi").select("band", "value")
    candidates = table(found.join(several, ["band", "value"]), "candidates")
    near = candidates.select("content").distinct()
    # A content that many documents share is one row per task before the join.
    one = occurrences.groupBy("content").agg(F.min(F.struct("_doc", "_tie", "place", "span")).alias("at")).join(near, "content").select("at.*")
    sets = table(shingle_table(docs, one).groupBy("content").agg(F.first("shingles").alias("shingles")), "sets")
    linked = components(near_links(candidates, sets, similarity))
    drop(found, candidates, sets, repeated)
    labelled = occurrences.join(linked.withColumnRenamed("node", "content"), "content", "left").select(
        "_doc", "_tie", "place", "head", "span", "words", F.coalesce("label", "content").alias("label"))
    labelled = table(labelled, "labelled")
    place, at = ["_doc", "_tie", "place"], ["o__doc", "o__tie", "o_place", "o_span"]

    def later(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Rows that are not the first of their label, with the place and span of that first; and the table of firsts."""
        firsts = table(rows.groupBy("label").agg(F.min(F.struct(*place, "span")).alias("at"), F.count(F.lit(1)).alias("n"))
                       .filter("n > 1").select("label", *[F.col(f"at.{c}").alias(f"o_{c}") for c in [*place, "span"]]), name)
        return rows.join(firsts, "label").filter("not (_doc = o__doc and _tie = o__tie and place = o_place)").select(*rows.columns, *at), firsts

    # Lines among lines; those of one paragraph against each other are left to the next step.
    lines, firsts = later(labelled.filter("span > 0"), "line-firsts")
    lines = table(lines.filter("span > 1 or o_span > 1").select("_doc", "_tie", "head", "span", "words", *at).distinct(), "gone-lines")
    left = table(labelled.filter("span < 2").join(lines.select("_doc", "_tie", "head"), ["_doc", "_tie", "head"], "left_anti"), "left")
    pieces, more = later(left, "firsts")
    # One row per place: rows equal in id and text are one document.
    all_gone = pieces.select("_doc", "_tie", F.col("place").alias("head"), F.lit(1).alias("span"), "words", *at).unionByName(lines).distinct()
    if least:
        all_gone = long_enough(docs, all_gone, least)
    origin = F.when(F.col("o__doc") != LAST, F.col("o__doc"))
    removed = table(all_gone.groupBy("_doc", "_tie").agg(
        F.flatten(F.collect_list(F.expr("sequence(head, head + span - 1)"))).alias("gone"), F.sum("span").alias("n_removed"), F.sum("words").alias("words_removed"),
        F.sort_array(F.collect_set(origin)).alias("origins")), "removed")     # of one text
    drop(occurrences, linked, labelled, firsts, lines, left, more)
    kept = [c for c in docs.columns if c not in ("text", "_doc", "_tie")]
    marked = docs.join(removed, ["_doc", "_tie"], "left").select(
        *kept, "text", "gone", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("words_removed", F.lit(0)).cast("long").alias("words_removed"),
        F.coalesce("origins", F.array().cast("array<bigint>")).alias("origins"))
    return cut_texts(marked, [*kept, "n_removed", "words_removed", "origins"]).select(*untuck(tucked, given), *own)
