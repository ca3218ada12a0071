"""Ordered scans, as-of joins, ranks and quantiles against brute force, with buckets of a few rows so
that every state crosses bucket borders."""

import random

import pytest
from pyspark.sql import functions as F

from tapewise.functions import ranks as K
from tapewise.functions import scan as S


def rows_of(seed, n=400, users=3):
    r = random.Random(seed)
    # One user owns most rows
    out = [("hot" if r.random() < 0.7 else f"u{r.randrange(users)}", t, round(r.uniform(-5, 5), 2)) for t in range(n)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("rows", [7, 10_000])
def test_running_and_previous(spark, rows):
    data = rows_of(1)
    df = spark.createDataFrame(data, "user string, t long, v double")
    got = {(r.user, r.t): r for r in S.previous(
        S.running_max(S.running_sum(df, ["user"], ["t"], {"s": F.col("v")}, rows), ["user"], ["t"], {"m": F.col("v")}, rows),
        ["user"], ["t"], {"p": F.col("v")}, rows).collect()}
    state = {}
    for u, t, v in sorted(data, key=lambda x: x[1]):
        s, m, p = state.get(u, (0.0, -1e9, None))
        s, m = s + v, max(m, v)
        r = got[(u, t)]
        assert r.s == pytest.approx(s) and r.m == m and r.p == p
        state[u] = (s, m, v)
    assert len(got) == len(data)


@pytest.mark.parametrize("rows", [5, 10_000])
def test_asof_both_directions(spark, rows):
    r = random.Random(2)
    left = [("a" if r.random() < 0.8 else "b", r.randrange(1000), i) for i in range(200)]
    right = list({(u, t): (u, t, float(t)) for u, t in (("a" if r.random() < 0.8 else "c", r.randrange(1000)) for _ in range(80))}.values())
    out = S.asof(spark.createDataFrame(left, "user string, t long, id int"), spark.createDataFrame(right, "user string, rt long, v double"),
                 ["user"], "t", "rt", ["v"], {"backward": "b_", "forward": "f_"}, 40, rows).collect()
    assert len(out) == len(left)
    for x in out:
        times = [t for u, t, _ in right if u == x.user]
        back = max((t for t in times if t <= x.t), default=None)
        fwd = min((t for t in times if t >= x.t), default=None)
        assert x.b_rt == (back if back is not None and x.t - back <= 40 else None)
        assert x.f_rt == (fwd if fwd is not None and fwd - x.t <= 40 else None)


@pytest.mark.parametrize("kind", ["burst", "instant"])
def test_slices_follow_rows_not_time(spark, kind):
    r = random.Random(6)
    # Nearly all rows of one user in one hour, or in one instant, of ten years.
    when = lambda i: r.randrange(10 ** 11) if i % 20 == 0 else (10 ** 10 + r.randrange(3_600_000) if kind == "burst" else 10 ** 10)
    df = spark.createDataFrame([("hot", when(i), i) for i in range(20_000)] + [("cold", i, i) for i in range(500)], "user string, t long, id long")
    cold, hot = S.split_hot(df, ["user"], ["t"], 1000)
    assert cold.count() == 500 and hot.count() == 20_000
    slices = hot.groupBy(S.BUCKET).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).orderBy(S.BUCKET).collect()
    assert max(s.n for s in slices) <= 2000
    assert all(a.hi <= b.lo for a, b in zip(slices, slices[1:]))
    assert S.split_hot(df, ["user"], ["t"], 30_000)[1] is None


@pytest.mark.parametrize("rows", [50, 10_000])
def test_asof_within_one_instant(spark, rows):
    left = [("a", 5, i) for i in range(600)] + [("a", 4, 600), ("a", 6, 601), (None, 5, 602)]
    right = [("a", 5, 1.0), ("a", 9, 2.0), (None, 5, 3.0)]
    out = S.asof(spark.createDataFrame(left, "user string, t long, id int"), spark.createDataFrame(right, "user string, rt long, v double"),
                 ["user"], "t", "rt", ["v"], {"backward": "b_", "forward": "f_"}, None, rows).collect()
    got = {x.id: (x.b_v, x.f_v) for x in out}
    assert got == {i: (1.0, 1.0) for i in range(600)} | {600: (None, 1.0), 601: (1.0, 2.0), 602: (3.0, 3.0)}


def test_affine_scan_survives_underflow(spark):
    r = random.Random(3)
    data = [("k", i, 0.0 if i == 0 or r.random() < 0.002 else (1.0 if r.random() < 0.3 else r.uniform(0.01, 0.9)), r.uniform(0, 10))
            for i in range(4000)]
    df = spark.createDataFrame(data, "k string, i long, w double, b double")
    got = {x.i: x.y for x in S.affine_scan(df, ["k"], ["i"], F.col("w"), F.col("b"), "y").collect()}
    y = 0.0
    for _, i, w, b in data:
        y = w * y + b
        assert got[i] == pytest.approx(y, rel=1e-9)


def test_ranks_and_quantiles(spark):
    r = random.Random(4)
    data = [("g" if r.random() < 0.9 else "h", f"u{i:03d}", r.choice([0.0, 0.5, -0.5, r.uniform(-3, 3)])) for i in range(500)]
    data += [("g", "nan", float("nan")), ("g", "null", None)]
    df = spark.createDataFrame(data, "k string, user string, v double")
    vals = {k: sorted(v for g, _, v in data if g == k and v is not None and v == v) for k in "gh"}
    for x in K.ranked(df, ["k"], "v", extra=("n", "above", "below", "ties")).collect():
        s = vals[x.k]
        if x.v is None or x.v != x.v:
            assert x["rank"] is None
            continue
        below, ties = sum(a < x.v for a in s), s.count(x.v)
        assert (x["rank"], x.n, x.below, x.ties, x.above) == (below + (ties + 1) / 2, len(s), below, ties, len(s) - below - ties)
    for x in K.exact_quantiles(df, ["k"], "v", nearest={"p95": 0.95}, size="n").collect():
        s, n = vals[x.k], len(vals[x.k])
        assert x.median == pytest.approx((s[(n - 1) // 2] + s[n // 2]) / 2)
        assert x.p95 == s[int((n - 1) * 0.95 + 0.5)] and x.n == n
    pos = {x.user: x.p for x in K.text_position(df.filter("k = 'g'"), ["k"], "user", "p").collect()}
    assert [u for u, _ in sorted(pos.items(), key=lambda i: i[1])] == sorted(u for g, u, _ in data if g == "g")


def test_positions_of_texts_with_a_common_start_are_spread(spark):
    names = [f"0xaaaaaaaaaa{i:05d}" for i in range(4000)]
    df = spark.createDataFrame([(g, n) for n in names for g in ("g", "h")], "k string, name string").repartition(3)
    conf = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = df.filter("k = 'g'").repartitionByRange("k", "name").groupBy(F.spark_partition_id()).count().collect()
        got = {(r.k, r["name"]): r.p for r in K.text_position(df, ["k"], "name", "p").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", conf)
    assert len(cut) == 4 and max(r["count"] for r in cut) < 2000
    assert got == {(g, n): i + 1 for i, n in enumerate(names) for g in ("g", "h")}


def test_quantiles_of_a_value_that_most_rows_share(spark):
    data = [("g", 7.0)] * 900 + [("g", float(v)) for v in range(100)] + [("h", 1.0), ("h", 4.0)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {x.k: x for x in K.exact_quantiles(df, ["k"], "v", nearest={"p0": 0.0, "p95": 0.95, "p99": 0.99}, size="n").collect()}
    s = sorted(v for k, v in data if k == "g")
    assert (got["g"].median, got["g"].p0, got["g"].p95, got["g"].p99, got["g"].n) == (7.0, 0.0, s[int(999 * 0.95 + 0.5)], s[int(999 * 0.99 + 0.5)], 1000)
    assert (got["h"].median, got["h"].n) == (2.5, 2)


def test_value_bucket_is_monotone(spark):
    vals = sorted([0.0, 5e-324, 1e-300, 0.1, 0.1000001, 1.0, 1.5, 2.0, 1e10, 1e300] + [-5e-324, -0.1, -1.0, -1e300])
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    cells = {r.v: r.c for r in df.select("v", K.value_bucket("v").alias("c")).collect()}
    assert [cells[v] for v in vals] == sorted(cells[v] for v in vals)


def test_zeros_between_gzip_members_are_no_padding():
    import gzip

    from tapewise.sources.raw import gzip_state

    member = gzip.compress(b"{}")
    assert gzip_state(member + b"\0" * 500) == "whole" and gzip_state(member + member) == "whole"
    assert gzip_state(member + b"\0" * 500 + member) == "damaged"


def test_deduplication_sorts_after_the_shuffle_only(spark):
    from tapewise.operators import latest as K
    fills = spark.createDataFrame([("a", 1, 1, "x"), ("a", 1, 1, "x"), ("a", 1, 1, "b"), (None, 2, 1, "c")], "user string, tid long, oid long, side string")
    once = K.dedup_fills(fills)
    assert once._jdf.queryExecution().executedPlan().toString().split("Exchange")[-1].count("Sort") == 0
    assert sorted(once.collect(), key=str) == sorted([("a", 1, 1, "b"), (None, 2, 1, "c")], key=str)


def test_tasks_fit_tables_of_any_size(spark):
    from tapewise.session import fit_tasks
    split, part = "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    keys = {k: spark.conf.get(k, None) for k in (split, part, first)}
    try:
        spark.conf.set(split, "128MB")
        spark.conf.set(part, "3m")
        fit_tasks(spark, 1 << 20)
        assert spark.conf.get(split) == str(16 << 20) and spark.conf.get(part) == "3m" and spark.conf.get(first) == "4"
        fit_tasks(spark, 6 << 30)
        assert spark.conf.get(first) == "3072"
    finally:
        for k, v in keys.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_version_changes_of_one_instant_do_not_depend_on_slices(spark):
    import random
    from tapewise.operators import quality as Q
    r = random.Random(3)
    rows = [("s", r.randrange(8), r.choice("abc"), i) for i in range(120)]
    want, before = [], None
    for s, at, etag, _ in sorted(rows, key=lambda x: (x[1], x[3])):
        if etag != before:
            want.append((s, etag, at))
        before = etag
    for parts, cut in ((1, 1000), (7, 1000), (7, 10)):
        r.shuffle(rows)
        df = spark.createDataFrame(rows, "source string, seen_ms long, etag string, id long").repartition(parts)
        assert sorted(map(tuple, Q.version_changes(df, ("id",), cut).collect())) == sorted(want)
