"""Files of appended gzip members, read by byte range.

A writer that appends each record as a gzip member of its own leaves files of very many small members, which grow. A
file is read from the offset where the last reading ended, and a long one in ranges, each by its own task. A range that does
not begin the reading looks for the first member whose header, deflate stream and checksum are sound; a member belongs to
the range it starts in. Ranges must meet: each has to begin where the one before ended, else the file is read again in
one piece, and that reading tells what is wrong with it. A task holds a megabyte of the file, and the longest line.

Files are opened with pyarrow, which knows local paths, hdfs, s3, gs and abfs."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Generator, Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared

FILE_PATTERN = "*.gz"
MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 20
RANGE_BYTES = 64 << 20
TAIL = 64       # bytes before an offset that tell whether a file has only grown

Read = Callable[[int, int], bytes]


def scan(read: Read, size: int, start: int, stop: int) -> Generator[tuple[int, bytes], None, tuple[str, int]]:
    """(offset of the member, decompressed bytes) of the members that start in [start, stop); returns the state and the
    offset behind the last complete member.

    States: whole; truncated (the file ends inside a member); damaged (anything else that is no gzip). Zeros up to the end
    of the file are padding. The time is linear in the bytes, however many members they hold."""
    block, base = memoryview(b""), start

    def bytes_at(pos: int, n: int) -> memoryview:
        nonlocal block, base
        if not base <= pos < base + len(block):
            block, base = memoryview(read(pos, min(BLOCK, size - pos))), pos
        return block[pos - base:pos - base + n]

    pos = start
    while pos < min(stop, size):
        member, step, inflate = pos, 1 << 10, zlib.decompressobj(wbits=31)
        if bytes_at(pos, 1)[0] == 0:
            while pos < size:
                some = bytes_at(pos, BLOCK)
                if bytes(some).strip(b"\0"):
                    return "damaged", member
                pos += len(some)
            return "whole", member
        while not inflate.eof:
            piece = bytes_at(pos, step) if pos < size else b""
            try:
                data = inflate.decompress(piece, BLOCK)
                while data:
                    yield member, data
                    data = inflate.decompress(inflate.unconsumed_tail, BLOCK) if not inflate.eof and (inflate.unconsumed_tail or len(data) == BLOCK) else b""
            except zlib.error:
                return "damaged", member
            if pos >= size and not inflate.eof:
                return "truncated", member
            # A small step: what follows a member's end is copied.
            pos += len(piece) - len(inflate.unused_data)
            step = min(2 * step, 1 << 16)
    return "whole", pos


def first_member(read: Read, size: int, start: int, stop: int) -> int | None:
    """Offset of the first sound member that starts in [start, stop)."""
    pos = start
    while pos < stop:
        block = read(pos, min(BLOCK, stop + len(MAGIC) - 1 - pos, size - pos))
        at = block.find(MAGIC)
        while at >= 0:
            found = scan(read, size, pos + at, pos + at + 1)
            try:
                while True:
                    next(found)
            except StopIteration as end:
                if end.value[0] == "whole":
                    return pos + at
            at = block.find(MAGIC, at + 1)
        pos += max(1, len(block) - len(MAGIC) + 1)
    return None


class Range:
    """The lines of one range: iterate over (offset of the member a line starts in, line); afterwards `head` (what comes
    before the first line break, unless the range begins the reading), `tail` and `tail_at` (what comes behind the last
    one), `broken` (whether there is a line break), `state`, `begin` and `end`."""

    def __init__(self, read: Read, size: int, start: int, stop: int, first: bool):
        self.read, self.size, self.start, self.stop, self.first = read, size, start, stop, first
        self.head, self.tail, self.tail_at, self.broken = b"", b"", None, first
        self.state, self.begin, self.end = "whole", start if first else None, None

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        if not self.first:
            self.begin = first_member(self.read, self.size, self.start, self.stop)
            if self.begin is None:
                return
        held, at = [], None
        members = scan(self.read, self.size, self.begin, self.stop)
        while True:
            try:
                member, data = next(members)
            except StopIteration as end:
                self.state, self.end = end.value
                break
            lines = data.split(b"\n")
            for line in lines[:-1]:
                whole = b"".join([*held, line])
                if self.broken:
                    yield member if at is None else at, whole
                else:
                    self.head, self.broken = whole, True
                held, at = [], None
            if lines[-1]:
                held.append(lines[-1])
                at = member if at is None else at
        if self.broken:
            self.tail, self.tail_at = b"".join(held), at
        else:
            self.head = b"".join(held)


@cache
def _store(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)[0]


def open_file(path: str):
    """A random-access file of a path as Spark names it."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (_store("file:///"), path)
    return store.open_input_file(name)


def reader(file) -> Read:
    return lambda offset, n: file.read_at(n, offset)


END = ("struct<begin:long,end:long,size:long,state:string,head:binary,tail:binary,tail_at:long,broken:boolean,before:binary>")
FOUND = f"path string, lo long, at long, value string, ends {END}"


def _text(line: bytes) -> str:
    return line.removesuffix(b"\r").decode("utf-8", "replace")


def _before(read: Read, offset: int) -> bytes:
    return read(max(0, offset - TAIL), min(TAIL, offset)) if offset else b""


def read_range(path: str, size: int, start: int, lo: int, hi: int, before: bytes | None) -> Iterator[tuple]:
    """Rows of one range as FOUND has them, its own row last. Where the bytes `before` the start are not those that were
    there, the file is another one and is read from its beginning."""
    with open_file(path) as file:
        read, first = reader(file), lo == start
        if first and start and _before(read, start) != before:
            lo = 0
        lines = Range(read, size, lo, hi, first)
        for at, line in lines:
            yield path, lo, at, _text(line), None
        after = lines.end if lines.tail_at is None else lines.tail_at
        yield path, lo, None, None, (lines.begin, lines.end, size, lines.state, lines.head, lines.tail, lines.tail_at, lines.broken,
                                     _before(read, after) if after is not None else None)


def _read(ranges: DataFrame) -> DataFrame:
    """Written rows (FOUND) of ranges (path, size, start, lo, hi, before)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("path", pa.string()), ("lo", pa.int64()), ("at", pa.int64()), ("value", pa.string()),
                           ("ends", pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("size", pa.int64()), ("state", pa.string()), ("head", pa.binary()),
                                                ("tail", pa.binary()), ("tail_at", pa.int64()), ("broken", pa.bool_()), ("before", pa.binary())]))])
        names = [f.name for f in kinds.field("ends").type]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            *plain, ends = zip(*rows)
            return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(plain, kinds)),
                                               pa.array([dict(zip(names, e)) if e else None for e in ends], kinds.field("ends").type)], schema=kinds)

        for batch in batches:
            for r in batch.to_pylist():
                rows, held = [], 0
                for row in read_range(r["path"], r["size"], r["start"], r["lo"], r["hi"], r["before"]):
                    rows.append(row)
                    held += len(row[3] or "")
                    if held > BLOCK or len(rows) >= 4096:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    total = ranges.agg(F.sum(F.col("hi") - F.col("lo")), F.count(F.lit(1))).first()
    tasks = max(1, min(total[1], max((total[0] or 0) // RANGE_BYTES + 1, ranges.sparkSession.sparkContext.defaultParallelism)))
    return shared(ranges.repartition(tasks, "path", "lo").mapInArrow(run, FOUND))


def _chain(part: pd.DataFrame) -> pd.DataFrame:
    """One file from the rows of its ranges: whether they meet, its state, where the next reading starts, and the lines that
    cross from one range into another."""
    part = part.sort_values("lo")
    path, start = part.path.iloc[0], int(part.lo.iloc[0])
    meets, state, end, lines, held, held_at, before = True, "whole", None, [], [], None, None
    for r in part.ends:
        if r["begin"] is None:      # inside a member of a range before, as far as this one can tell
            continue
        meets &= end is None or (end == r["begin"] and state == "whole")
        if r["head"]:
            held.append(bytes(r["head"]))
            held_at = r["begin"] if held_at is None else held_at
        if r["broken"]:
            if held:
                lines.append((held_at, _text(b"".join(held))))
            held, held_at = ([bytes(r["tail"])], r["tail_at"]) if r["tail"] else ([], None)
        state, end, before = r["state"], r["end"], bytes(r["before"])
    size = int(part.ends.iloc[0]["size"])
    # What no range has read: its members are not sound.
    meets &= state != "whole" or end == size or len(part) == 1
    if held:
        lines.append((held_at, _text(b"".join(held))))
    resume = end if held_at is None else held_at
    return pd.DataFrame({"path": [path], "start": [start], "resume": [resume], "size": [size], "state": [state], "before": [before], "meets": [bool(meets)],
                         "lines": [[{"at": a, "value": v} for a, v in lines]]})


FILES = ("path string, start long, resume long, size long, state string, before binary, meets boolean, "
         "lines array<struct<at:long,value:string>>")


def _files(found: DataFrame) -> DataFrame:
    """One row per file (FILES) from the rows of its ranges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("resume", pa.int64()), ("size", pa.int64()), ("state", pa.string()),
                            ("before", pa.binary()), ("meets", pa.bool_()), ("lines", pa.list_(pa.struct([("at", pa.int64()), ("value", pa.string())])))])
        for batch in batches:
            out = [_chain(pd.DataFrame({"path": [r["path"]] * len(r["ranges"]), "lo": [x["lo"] for x in r["ranges"]], "ends": [x["ends"] for x in r["ranges"]]}))
                   for r in batch.to_pylist()]
            if out:
                yield from pa.Table.from_pandas(pd.concat(out), schema, preserve_index=False).to_batches()

    # A file has one range per RANGE_BYTES.
    rows = found.filter("ends is not null").groupBy("path").agg(F.collect_list(F.struct("lo", "ends")).alias("ranges"))
    return rows.mapInArrow(run, FILES)


def listed(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """(path, mtime, size) of the gzip files below a path; no content is read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", FILE_PATTERN).option("recursiveFileLookup", "true").options(**options)
    return reader.load(path).select(F.col("_metadata.file_path").alias("path"), F.unix_millis("_metadata.file_modification_time").alias("mtime"),
                                    F.col("_metadata.file_size").alias("size"))


def read_members(files: DataFrame, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lines, states) of files (path, size, start, before): read from the offset `start` on, whose `before` bytes must be
    as given, else from the beginning.

    lines: path, at (offset of the member the line starts in), value; files with damage give none. states: path, start
    (where the reading began), resume (where the next one has to begin: behind the last complete member, or at the one in
    which an unfinished line begins), size, state, before (bytes before `resume`). Everything is written once to the
    shared folder, a file's state being known at its end only."""
    asked = files.select("path", "size", "start", F.expr("least(start, size)").alias("from"), "before")
    pieces = F.greatest(F.lit(1), F.ceil((F.col("size") - F.col("from")) / range_bytes)).cast("int")
    ranges = asked.select("path", "size", F.col("from").alias("start"), "before", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("k"))
    ranges = ranges.select("path", "size", "start", "before", (F.col("start") + F.col("k") * F.lit(range_bytes).cast("long")).alias("lo")).withColumn(
        "hi", F.least(F.col("lo") + range_bytes, "size"))
    found = _read(ranges)
    files_read = shared(_files(found))
    lines = found.filter("ends is null").select("path", "at", "value")
    sound, crossing = files_read, files_read.select("path", F.explode("lines").alias("l")).select("path", "l.at", "l.value")
    apart = files_read.filter("not meets").select("path", "size", "start")
    if not apart.isEmpty():
        before = asked.select("path", "before")
        again = _read(apart.join(before, "path").select("path", "size", "start", "before", F.col("start").alias("lo"), F.col("size").alias("hi")))
        second = shared(_files(again))
        sound = sound.filter("meets").unionByName(second)
        first_lines = lines.unionByName(crossing).join(apart, "path", "left_anti")
        lines = first_lines.unionByName(again.filter("ends is null").select("path", "at", "value"))
        crossing = second.select("path", F.explode("lines").alias("l")).select("path", "l.at", "l.value")
    lines = lines.unionByName(crossing).join(sound.filter("state = 'damaged'").select("path"), "path", "left_anti")
    return lines, sound.select("path", "start", "resume", "size", "state", "before")
