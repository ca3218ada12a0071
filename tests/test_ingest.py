"""Files of gzip members: ranges, growth, restarts; processed tables by date."""

import gzip
import json
import os
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from tapewise.session import new_folder
from tapewise.sources import members, raw, tables
from tapewise.streaming import jobs


def member(text):
    return gzip.compress(text if isinstance(text, bytes) else text.encode(), mtime=0)


def of(content):
    return lambda offset, n: content[offset:offset + n]


def lines_of(content, ranges, start=0):
    """(lines, chained row) of a file read in equal ranges, as tasks would."""
    import pandas as pd

    edges = [start + (len(content) - start) * k // ranges for k in range(ranges + 1)]
    lines, ends = [], []
    for lo, hi in zip(edges, edges[1:]):
        part = members.Range(of(content), len(content), lo, hi, lo == start)
        lines += list(part)
        after = part.end if part.tail_at is None else part.tail_at
        ends.append({"begin": part.begin, "end": part.end, "size": len(content), "state": part.state, "head": part.head, "tail": part.tail,
                     "tail_at": part.tail_at, "broken": part.broken, "before": b"" if after is None else content[max(0, after - 64):after]})
    row = members._chain(pd.DataFrame({"path": ["f"] * ranges, "lo": edges[:-1], "ends": ends})).iloc[0]
    return sorted([(a, v.decode("utf-8", "replace")) for a, v in lines] + [(x["at"], x["value"]) for x in row["lines"]], key=lambda x: x[0]), row


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
@pytest.mark.parametrize("cut", ["lines", "anywhere"])
def test_ranges_give_the_lines_of_the_file(ranges, cut):
    r = random.Random(5)
    text = "".join(f"{i} " + "x" * r.choice([0, 3, 900]) + "\n" for i in range(400)) + "no break"
    if cut == "lines":      # every member ends with a line break, as the writer has it
        content = b"".join(member(line) for line in text.splitlines(keepends=True))
    else:
        edges = [0, *sorted(r.sample(range(len(text)), 60)), len(text)]
        content = b"".join(member(text[a:b]) for a, b in zip(edges, edges[1:]))
    got, row = lines_of(content, ranges)
    assert row.meets and row.state == "whole"
    assert sorted(v for _, v in got) == sorted(text.split("\n"))
    assert row.resume == max(a for a, v in got if v.startswith("no break"))      # the unfinished line is read again


def test_ranges_see_damage_and_an_early_end():
    content = b"".join(member(f"line {i}\n" * 20) for i in range(200))
    at = content.find(members.MAGIC, 5000) + 14         # inside a deflate stream
    for spoiled in (content[:at] + bytes([content[at] ^ 0x55]) + content[at + 1:], content[:6000] + b"\0" * 100 + content[6000:]):
        row = lines_of(spoiled, 6)[1]
        assert not row.meets or row.state == "damaged"
        assert lines_of(spoiled, 1)[1].state == "damaged"
    got, row = lines_of(content[:-10], 6)
    assert row.meets and row.state == "truncated" and len(got) >= 199 * 20 and content[row.resume:row.resume + 3] == members.MAGIC
    inside = gzip.compress(b"".join(member(f"{i}\n") for i in range(300)), 0)     # sound members inside a member
    assert not lines_of(inside, 6)[1].meets and lines_of(inside, 1)[1].state == "whole"


def test_many_small_members_in_linear_time():
    one = b"".join(member(f"{i}\n") for i in range(1000))
    took = {}
    for times in (25, 100):
        content = one * times
        start = time.perf_counter()
        assert sum(1 for _ in members.Range(of(content), len(content), 0, len(content), True)) == 1000 * times
        took[times] = time.perf_counter() - start
    assert took[100] < 10 and took[100] < 12 * took[25]


def test_a_member_that_inflates_a_thousandfold_is_read_in_blocks():
    content = member(b"a" * (50 << 20) + b"\nb")
    sizes = [len(d) for _, d in members.scan(of(content), len(content), 0, len(content))]
    assert max(sizes) <= members.BLOCK and sum(sizes) == (50 << 20) + 2


# --- through Spark -----------------------------------------------------------------------------------

def record(i, user="0xA", pad=0):
    return json.dumps({"platform": "p", "dataset": "fills", "fetched_at": "2026-01-01T00:00:00+00:00", "request": {"user": user}, "payload": [
        {"time": 1000 + i, "coin": "BTC", "side": "B", "dir": "Open Long", "px": "1", "sz": "2", "startPosition": "0", "closedPnl": "0", "fee": "0.1", "oid": i,
         "tid": i, "hash": "".join(random.Random(i).choices("0123456789abcdef", k=pad))}]}) + "\n"


class Raw:
    """A folder of raw files whose times go on."""

    def __init__(self, path):
        self.root, self.now = path / "raw" / "fills", time.time() - 10_000

    def put(self, day, run, content, append=False):
        folder = self.root / f"date={day}"
        folder.mkdir(parents=True, exist_ok=True)
        file = folder / f"{run}.jsonl.gz"
        with open(file, "ab" if append else "wb") as f:
            f.write(content)
        self.now += 10
        os.utime(file, (self.now, self.now))
        return file


def tids(spark, out, **kw):
    table = tables.read_table(spark, out, "fills", **kw)
    return [] if table is None else sorted(r.tid for r in table.select("tid").collect())


def test_a_long_file_in_ranges(spark, tmp_path):
    box = Raw(tmp_path)
    content = b"".join(member(record(i, pad=200)) for i in range(300))
    box.put("2026-01-01", "a b%", content)        # a name that a URI has to escape
    box.put("2026-01-01", "bad", content[:40_000] + b"\1" + content[40_001:])
    box.put("2026-01-01", "empty", b"")         # holds nothing, and is not listed
    files = raw.from_the_beginning(members.listed(spark, str(box.root)))
    lines, states = members.read_members(files, range_bytes=10_000)
    assert {r.path.rpartition("/")[2][:3]: r.state for r in states.collect()} == {"a%2": "whole", "bad": "damaged"}
    assert sorted(raw.fill_rows(raw.parse_records(lines)).select("tid").toPandas().tid) == list(range(300))


def test_only_what_was_appended_is_read(spark, tmp_path, monkeypatch):
    box, out = Raw(tmp_path), str(tmp_path / "out")
    run = lambda: tables.normalize_dataset(spark, str(box.root), "fills", out)
    asked = []
    whole = tables.read_members
    monkeypatch.setattr(tables, "read_members", lambda files: (asked.extend((r.start, r.size) for r in files.select("start", "size").collect()), whole(files))[1])
    first = b"".join(member(record(i)) for i in range(50))
    box.put("2026-01-01", "a", first)
    box.put("2026-01-02", "b", member(record(1000)))
    assert run() == 2 and run() == 0
    new = b"".join(member(record(i)) for i in range(50, 53))
    box.put("2026-01-01", "a", new[:-5], append=True)             # its last member is still to come
    assert run() == 1
    box.put("2026-01-01", "a", new[-5:], append=True)
    assert run() == 1 and run() == 0
    assert tids(spark, out) == [*range(53), 1000]
    assert asked[:2] == [(0, len(first)), (0, asked[1][1])] or asked[1::-1][0][0] == 0
    assert asked[2] == (len(first), len(first) + len(new) - 5) and asked[3][0] == len(first) + len(b"".join(member(record(i)) for i in (50, 51)))
    box.put("2026-01-01", "a", b"".join(member(record(i)) for i in range(2000, 2200)))     # another file, longer than the old one
    assert run() == 1 and tids(spark, out) == [1000, *range(2000, 2200)]
    box.put("2026-01-01", "a", member("\n"))                   # nothing is left of it
    assert run() == 1 and tids(spark, out) == [1000]


@pytest.mark.parametrize("stop", ["append", "stage", "apply", "ledger"])
def test_a_stopped_run_loses_and_repeats_nothing(spark, tmp_path, monkeypatch, stop):
    box, out = Raw(tmp_path), str(tmp_path / "out")
    run = lambda: tables.normalize_dataset(spark, str(box.root), "fills", out, files_per_date=2)
    for k in range(2):
        box.put("2026-01-01", f"r{k}", member(record(k)))
        run()
    box.put("2026-01-01", "r0", member(record(10)), append=True)
    box.put("2026-01-02", "n", member(record(20)))
    write, n = tables._write, {"stage": 0, "append": 1, "apply": 2}

    def stopped(df, path, mode, calls=[]):     # noqa: B006
        calls.append(path)
        write(df, path, mode)
        if len(calls) - 1 == n.get(stop):
            raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(tables, "_write", stopped)
        if stop == "ledger":
            m.setattr(tables.time, "time_ns", lambda: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            run()
    assert run() == 2 and run() == 0
    assert tids(spark, out) == [0, 1, 10, 20]
    assert tables._children(spark, f"{out}/{tables.STAGED}/fills") == []


def test_files_per_date_are_bounded(spark, tmp_path):
    box, out = Raw(tmp_path), str(tmp_path / "out")
    for k in range(5):
        box.put("2026-01-01", f"r{k}", member(record(k)))
        tables.normalize_dataset(spark, str(box.root), "fills", out, files_per_date=2)
        assert len([f for f in os.listdir(f"{out}/fills/date=2026-01-01") if f.endswith(".parquet")]) <= 3
    assert tids(spark, out) == list(range(5))


def test_dates_prune_partitions(spark, tmp_path):
    box, out = Raw(tmp_path), str(tmp_path / "out")
    for day in range(1, 6):
        box.put(f"2026-01-0{day}", "r", member(record(day)))
    tables.normalize_dataset(spark, str(box.root), "fills", out)
    some = tables.read_table(spark, out, "fills", "2026-01-02", "2026-01-03")
    assert tids(spark, out, first="2026-01-02", last="2026-01-03") == [2, 3] and tids(spark, out, first="2026-01-05") == [5]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "2026-01-02" in plan and len(some.inputFiles()) == 5     # listed, two of them read
    assert some.select(F.input_file_name()).distinct().count() == 2
    calendar = spark.createDataFrame([("2026-01-04", 1), ("2026-01-05", 0)], "date string, open int")
    path = new_folder(spark, "calendar")
    calendar.write.parquet(path)
    by_join = tables.read_table(spark, out, "fills", dates=spark.read.parquet(path).filter("open = 1"))
    assert "dynamicpruning" in by_join._jdf.queryExecution().executedPlan().toString()
    assert [r.tid for r in by_join.collect()] == [4]


def test_drifted_columns(spark, tmp_path):
    box, out = Raw(tmp_path), str(tmp_path / "out")
    assert tables.drifted_columns(spark, out, "fills").collect() == []
    box.put("2026-01-01", "r", member(record(1)))
    tables.normalize_dataset(spark, str(box.root), "fills", out)
    assert tables.drifted_columns(spark, out, "fills").collect() == []
    spark.range(1).coalesce(1).selectExpr("'u' as user", "cast(id as int) as time_ms", "'x' as surplus").write.parquet(f"{out}/fills/date=2025-01-01")
    got = {(r.column, r.expected, r.found, r.files) for r in tables.drifted_columns(spark, out, "fills").collect()}
    assert got >= {("time_ms", "bigint", "int", 1), ("surplus", None, "string", 1), ("px", "double", None, 1)} and not any(g[0] == "user" for g in got)


def test_a_stream_follows_growing_files(spark, tmp_path):
    box, out = Raw(tmp_path), str(tmp_path / "out")
    box.put("2026-01-01", "a", member(record(1)))
    start = lambda: jobs.stream_ingest(spark, str(box.root), "fills", out, str(tmp_path / "log"), follow="1 second")

    def wait(query, want):
        end = time.time() + 60
        while tids(spark, out) != want and time.time() < end and query.exception() is None:
            time.sleep(0.5)
        assert tids(spark, out) == want

    for known, grown, want in (([1], 10, [1, 10]), ([1, 2, 10], 20, [1, 2, 10, 20])):
        if grown == 20:         # grown while nothing was running
            box.put("2026-01-01", "a", member(record(2)), append=True)
        query = start()
        try:
            wait(query, known)
            box.put("2026-01-01", "a", member(record(grown)), append=True)
            wait(query, want)
        finally:
            query.stop()
