"""Fills, books, risk, raw records and streams."""

import gzip
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tapewise.functions.exprs import DAY_MS
from tapewise.operators import behavior as H
from tapewise.operators import books as P
from tapewise.operators import risk as G
from tapewise.sources import raw, tables
from tapewise.streaming import jobs

FILLS = ("user string, time_ms long, coin string, side string, dir string, px double, sz double, start_position double, "
         "closed_pnl double, fee double, liquidated boolean, oid long, tid long")


def tape(seed, n=600, users=("hot", "cold"), gaps=True):
    """A consistent random tape with adds, reductions, flips and lost fills."""
    r, pos, rows = random.Random(seed), {}, []
    for i in range(n):
        u = users[0] if r.random() < 0.8 else users[1]
        coin = r.choice(["BTC", "ETH"])
        start = pos.get((u, coin), 0.0)
        size = r.choice([1.0, 2.0, 3.0]) if start == 0 or r.random() < 0.5 else r.choice([abs(start), abs(start) / 2, abs(start) + 1.0])
        signed = size if r.random() < 0.5 else -size
        after = start + signed
        name = "Long > Short" if start > 0 > after else "Short > Long" if start < 0 < after else "Open Long"
        if not gaps or r.random() > 0.03:
            rows.append((u, i * DAY_MS // 40, coin, "B" if signed > 0 else "A", name, round(100 + 20 * r.random(), 2), abs(signed), start,
                         round(r.uniform(-5, 5), 2), 0.1 * size, r.random() < 0.02, i, i))
        pos[(u, coin)] = after
    return rows


def legs(*rows):
    """Fills (user, coin, time, dir, px, signed size, position before, realized PnL) with a fee of 1 each."""
    return [(u, t, c, "B" if q > 0 else "A", d, px, abs(q), start, pnl, 1.0, False, i, i) for i, (u, c, t, d, px, q, start, pnl) in enumerate(rows)]


TAPE = legs(
    ("a", "BTC", 1, "Open Long", 100.0, 2.0, 0.0, 0.0), ("a", "BTC", 2, "Open Long", 90.0, 2.0, 2.0, 0.0),      # 4 at 95, the add below the entry
    ("a", "BTC", 3, "Close Long", 110.0, -1.0, 4.0, 15.0), ("a", "BTC", 4, "Close Long", 120.0, -3.0, 3.0, 75.0),
    ("a", "BTC", 5, "Open Short", 120.0, -5.0, 0.0, 0.0), ("a", "BTC", 6, "Short > Long", 100.0, 8.0, -5.0, 100.0),       # flips to 3 at 100
    ("a", "BTC", 7, "Open Long", 112.0, 2.0, 10.0, 0.0),      # the fills from 3 to 10 are lost
    ("a", "ETH", 5, "Open Long", 10.0, 1.0, 0.0, 0.0),
    ("b", "ETH", 1, "Open Short", 50.0, -1.0, 0.0, 0.0), ("b", "ETH", 2, "Open Short", 60.0, -1.0, -1.0, 0.0),     # 2 at 55, against the position
    ("b", "ETH", 3, "Open Short", 40.0, -2.0, -2.0, 0.0), ("b", "ETH", 4, "Close Short", 45.0, 4.0, -4.0, 10.0))
# user, coin, opened, closed, side, fills, adds, adds at a loss, partial exits, initial and largest notional, entry, net PnL
TRADES = [
    ("a", "BTC", 1, 4, "long", 4, 1, 1, 1, 200.0, 440.0, 95.0, 86.0),
    ("a", "BTC", 5, 6, "short", 2, 0, 0, 0, 600.0, 600.0, 120.0, 100.0 - 1.0 - 5 / 8),
    ("a", "BTC", 6, None, "long", 2, 1, 0, 0, 300.0, 1344.0, 102.0, -1.0 - 3 / 8),
    ("a", "ETH", 5, None, "long", 1, 0, 0, 0, 10.0, 10.0, 10.0, -1.0),
    ("b", "ETH", 1, 4, "short", 4, 2, 1, 0, 50.0, 180.0, 47.5, 6.0)]
GROSS = {("a", 1, ""): 200.0, ("a", 2, ""): 360.0, ("a", 3, ""): 330.0, ("a", 4, ""): 0.0, ("a", 6, "close"): 10.0, ("a", 6, "open"): 310.0, ("a", 7, ""): 1354.0,
         ("b", 1, ""): 50.0, ("b", 2, ""): 120.0, ("b", 3, ""): 160.0, ("b", 4, ""): 0.0}


@pytest.mark.parametrize("rows", [2, 10_000])
def test_round_trips_and_exposure_of_a_known_tape(spark, rows):
    perp = H.perp_fills(spark.createDataFrame(TAPE, FILLS)).persist()
    got = sorted((t.user, t.coin, t.opened_ms, t.closed_ms, t.side, t.n_fills, t.n_adds, t.n_adds_losing, t.n_partial_exits, t.initial_notional,
                  t.max_notional, round(t.avg_entry, 9), round(t.pnl_net, 9)) for t in H.round_trips(perp, rows).collect())
    assert got == TRADES
    path = {(r.user, r.time_ms, r.leg): r.gross for r in H.gross_notional(perp, rows).collect() if (r.user, r.time_ms) != ("a", 5)}
    assert path == pytest.approx(GROSS)


def test_round_trips_account_for_every_fill_whatever_the_slices(spark):
    perp = H.perp_fills(spark.createDataFrame(tape(1), FILLS)).persist()
    fills = perp.toPandas()
    # Nobody is hot, everybody is, one user is.
    whole, *cuts = ({(t.user, t.coin, t.opened_ms, t.open_tid, t.open_leg): t.asDict() for t in H.round_trips(perp, n).collect()}
                    for n in (10_000, 9, 120))
    assert len(whole) > 50
    for cut in cuts:
        assert whole.keys() == cut.keys()
        for k, t in whole.items():
            assert {c: v for c, v in t.items() if not isinstance(v, float)} == {c: v for c, v in cut[k].items() if not isinstance(v, float)}
            assert {c: v for c, v in t.items() if isinstance(v, float)} == pytest.approx({c: v for c, v in cut[k].items() if isinstance(v, float)})
            assert t["n_adds_losing"] <= t["n_adds"] and t["initial_notional"] <= t["max_notional"] + 1e-9
    assert sum(t["n_fills"] for t in whole.values()) == len(fills)
    assert sum(t["pnl_net"] for t in whole.values()) == pytest.approx((fills.closed_pnl - fills.fee).sum())
    # Gross: the last value of each coin, summed.
    fills["x"] = fills.position_after.abs() * fills.px
    for n in (10_000, 9, 300):
        path = {(r.user, r.time_ms, r.tid, r.leg): r.gross for r in H.gross_notional(perp, n).collect()}
        for user, g in fills.groupby("user"):
            wide = g.sort_values(["time_ms", "tid", "leg"]).set_index(["time_ms", "tid", "leg"]).pivot(columns="coin", values="x")
            for at, total in wide.sort_index().ffill().fillna(0).sum(axis=1).items():
                assert path[(user, *at)] == pytest.approx(total, abs=1e-6)


def test_small_positions_are_not_taken_for_rounding(spark):
    tiny = legs(("s", "A", 1, "Open Long", 1e-9, 2.0, 0.0, 0.0), ("s", "A", 2, "Close Long", 1e-9, -1.0, 2.0, 0.0), ("s", "A", 3, "Close Long", 1e-9, -1.0, 1.0, 0.0))
    big = legs(*[("b", c, i, "Open Long", p, q, st, 0.0) for i, (c, p, q, st) in enumerate(
        [("A", 0.1, 3.0, 0.0), ("B", 0.7, 1.0, 0.0), ("A", 0.1, -3.0, 3.0), ("B", 0.7, -1.0, 1.0)])])
    perp = H.perp_fills(spark.createDataFrame(tiny + big, FILLS)).persist()
    for n in (1, 10_000):
        path = {(r.user, r.time_ms): r.gross for r in H.gross_notional(perp, n).collect()}
        assert [path["s", t] for t in (1, 2, 3)] == pytest.approx([2e-9, 1e-9, 0.0], abs=1e-18) and path["s", 3] == path["b", 3] == 0.0


def test_flip_is_split(spark):
    rows = [("u", 1, "BTC", "B", "Open Long", 100.0, 4.0, 0.0, 0.0, 4.0, False, 1, 1),
            ("u", 2, "BTC", "A", "Long > Short", 110.0, 7.0, 4.0, 40.0, 7.0, True, 2, 2),
            ("u", 3, "@12", "B", "Buy", 1.0, 1.0, 0.0, 0.0, 0.0, False, 3, 3),
            ("u", 3, "PURR/USDC", "B", "Open Long", 1.0, 1.0, 0.0, 0.0, 0.0, False, 4, 4)]
    legs = H.perp_fills(spark.createDataFrame(rows, FILLS)).orderBy("time_ms", "leg").collect()
    assert [(r.leg, r.signed_sz, r.position_after, r.closed_pnl, r.fee, r.liquidated) for r in legs] == [
        ("", 4.0, 4.0, 0.0, 4.0, False), ("close", -4.0, 0.0, 40.0, 4.0, True), ("open", -3.0, -3.0, 0.0, 3.0, False)]


def test_equity_choice_for_leverage(spark):
    day = DAY_MS
    fills = spark.createDataFrame([("u", 20 * day, "BTC", "B", "Open Long", 100.0, 10.0, 0.0, 0.0, 0.0, False, 1, 1)], FILLS)
    equity = spark.createDataFrame([("u", "month", 10 * day, 20.0, 0.0), ("u", "month", 23 * day, 500.0, 0.0)],
                                   "user string, period string, time_ms long, account_value double, pnl double")
    r = H.gross_exposure(H.perp_fills(fills), equity).collect()[0]
    assert (r.gross, r.equity, r.leverage) == (1000.0, 500.0, 2.0)
    poor = equity.withColumn("account_value", F.lit(1.0))
    assert H.gross_exposure(H.perp_fills(fills), poor).collect()[0].leverage is None


def test_features_do_not_depend_on_partitioning_or_copies(spark):
    fills = spark.createDataFrame(tape(7, gaps=False), FILLS)
    equity = spark.createDataFrame([(u, "month", t * DAY_MS, 5000.0, 0.0) for u in ("hot", "cold") for t in range(0, 20)],
                                   "user string, period string, time_ms long, account_value double, pnl double")
    now = 16 * DAY_MS
    show = lambda d: sorted(str(r) for r in d.select("user", "n_trades", F.round("hhi", 9), F.round("p95_leverage", 9),
                                                     F.round("martingale_share", 9), F.round("copyability_estimate", 9)).collect())
    a = show(H.behavior_features(fills, equity, now, 15, 5))
    b = show(H.behavior_features(fills.unionByName(fills).repartition(7), equity, now, 15, 5))
    assert a == b and len(a) == 2


MARKETS = "coin string, mid double, oracle double, funding double, impact_bid double, impact_ask double, sz_decimals int"


def test_book_rules(spark):
    m = spark.createDataFrame([(c, 100.0, 100.0, 0.001, 99.9, 100.1, d) for c, d in (("A", None), ("B", None), ("C", None), ("D", 2))], MARKETS)
    targets = spark.createDataFrame([(1, "A", 1050.0), (1, "B", -500.0), (1, "D", 1234.5)], "book_id int, coin string, target double")
    held = spark.createDataFrame([(1, "A", 10.0), (1, "B", 5.0), (1, "C", 0.05), (1, "X", 3.0)], "book_id int, coin string, size double")
    plan = {r.coin: r.delta for r in P.rebalance_gaps(targets, held, m).collect()}
    assert plan == {"B": -10.0, "C": -0.05, "D": pytest.approx(12.34)}      # A within the band, X unpriced, half-even lot
    cost = P.trade_cost(spark.createDataFrame([("A", 2.0), ("B", -2.0)], "coin string, delta double"), m)
    c = {r.coin: r for r in cost.collect()}
    assert c["A"].price == 100.1 and c["B"].price == 99.9 and c["A"].fee == pytest.approx(200.2 * 0.00045)
    assert P.funding_charges(held, m, 2).filter("coin = 'A'").collect()[0].payment == pytest.approx(2.0)


def test_copy_targets_scale_to_the_leverage_cap(spark):
    m = spark.createDataFrame([("A", 100.0, 100.0, 0.0, None, None, None)], MARKETS)
    books = spark.createDataFrame([(1, "t", 1000.0), (2, "t", -1.0)], "book_id int, trader string, equity double")
    pos = spark.createDataFrame([("t", "A", 100.0)], "trader string, coin string, size double")
    eq = spark.createDataFrame([("t", 1000.0)], "trader string, trader_equity double")
    rows = P.copy_targets(books, pos, eq, m).collect()
    assert [(r.book_id, r.target, r.scale) for r in rows] == [(1, 5000.0, 0.5)]


def test_groups_and_allocation(spark):
    r = random.Random(3)
    base = [r.gauss(0, 0.01) for _ in range(20)]
    rows = [("a", d, x) for d, x in enumerate(base)] + [("b", d, 2 * x) for d, x in enumerate(base)]
    rows += [("c", d, r.gauss(0, 0.01)) for d in range(20)] + [("e", d, x) for d, x in enumerate(base[:5])]
    daily = spark.createDataFrame(rows, "user string, day_ms long, ret double")
    chosen = spark.createDataFrame([("s", u) for u in "abce"] + [("z", "a")], "grp string, user string")
    for block in (1, 256):
        pairs = G.correlated_pairs(daily, chosen, block_users=block)
        assert [(p.grp, p.a, p.b, p.days) for p in pairs.collect()] == [("s", "a", "b", 20)]
    groups = {(x.grp, x.user): x.component for x in G.correlation_groups(pairs, chosen).collect()}
    assert groups == {("s", "a"): "a", ("s", "b"): "a", ("s", "c"): "c", ("s", "e"): "e", ("z", "a"): "a"}
    w = {(x.grp, x.user): x.weight for x in G.allocate(G.correlation_groups(pairs, chosen), 0.3, 0.4).collect()}
    assert w[("s", "a")] == pytest.approx(0.2) and w[("s", "c")] == pytest.approx(0.25) and w[("z", "a")] == pytest.approx(0.3)


def test_long_chain_is_one_component(spark):
    n = 60
    users = [f"u{i:02d}" for i in range(n)]
    random.Random(1).shuffle(users)
    pairs = spark.createDataFrame([("g", *sorted(p)) for p in zip(users, users[1:])], "grp string, a string, b string")
    chosen = spark.createDataFrame([("g", u) for u in users], "grp string, user string")
    assert {r.component for r in G.correlation_groups(pairs, chosen).collect()} == {"u00"}


@pytest.mark.parametrize("block", [3, 1000])
def test_correlated_pairs_of_traders_who_come_and_go(spark, block):
    r, rows = random.Random(5), []
    mood = {d: r.gauss(0, 1) for d in range(200)}
    for u in range(24):
        begin, n = 8 * u, r.choice([5, 12, 40, 60])         # late traders share no days with early ones
        rows += [(f"u{u:02d}", d * DAY_MS, (1 if u % 3 else -1) * mood[d] / 50 + r.gauss(0, 0.01))
                 for d in range(begin, min(begin + n, 200)) if r.random() < 0.95]
    rows += [("flat", d * DAY_MS, 0.0) for d in range(60)] + [("gone", 1, None)]
    daily = spark.createDataFrame(rows, "user string, day_ms long, ret double")
    users = sorted({u for u, _, _ in rows})
    chosen = spark.createDataFrame([("g", u) for u in users] + [("h", u) for u in users[:4]] + [("g", "unknown")], "grp string, user string")
    wide = daily.toPandas().dropna().pivot(index="day_ms", columns="user", values="ret")
    want = {}
    for group, among in (("g", users), ("h", users[:4])):
        for i, a in enumerate(among):
            for b in among[i + 1:]:
                both = wide[[a, b]].dropna() if {a, b} <= set(wide) else []
                if len(both) >= 12 and both.std().min() > 0 and both.corr().iloc[0, 1] >= 0.5:
                    want[group, a, b] = (len(both), pytest.approx(both.corr().iloc[0, 1]))
    got = {(x.grp, x.a, x.b): (x.days, x["corr"]) for x in G.correlated_pairs(daily, chosen, 0.5, 12, block, DAY_MS).collect()}
    assert got == want and len(want) > 5
    assert G.correlated_pairs(daily.limit(0), chosen).count() == G.correlated_pairs(daily, chosen.limit(0)).count() == 0


def test_tracking_gap(spark):
    rows = []
    for h in range(6):
        rows.append((1, h * 3_600_000, 1000 * 1.009 ** h, 1000 * 1.01 ** h, 1000 * (1.01 ** h - 1), None))
    snaps = spark.createDataFrame(rows, "book_id int, ts_ms long, equity double, trader_equity double, trader_perp_pnl double, leverage_scale double")
    books = spark.createDataFrame([(1, "s", "t")], "book_id int, strategy string, trader string")
    r = P.tracking_report(snaps, books).collect()[0]
    assert r.hours == 5 and r.gap_per_day == pytest.approx(-0.024, abs=1e-6) and r.active


def envelope(user, payload, **kw):
    return json.dumps({"platform": "p", "dataset": "fills", "fetched_at": "2026-01-01T00:00:00+00:00",
                       "request": {"user": user}, "payload": payload} | kw)


def fill(tid, liquidated=None):
    f = {"time": 1000 + tid, "coin": "BTC", "side": "B", "dir": "Open Long", "px": "100.5", "sz": "2", "startPosition": "0.0",
         "closedPnl": "0", "fee": "0.1", "oid": tid, "tid": tid, "hash": "0x"}
    return f | ({"liquidation": {"liquidatedUser": liquidated}} if liquidated else {})


def test_truncated_gzip_and_incremental_normalization(spark, tmp_path):
    folder = tmp_path / "raw" / "fills" / "date=2026-01-01"
    folder.mkdir(parents=True)
    first = gzip.compress((envelope("0xA", [fill(1, "0xa"), fill(2, "0xB")]) + "\n\n").encode())
    second = gzip.compress((envelope("0xA", [fill(3)]) + "\n").encode())
    path = folder / "run1.jsonl.gz"
    path.write_bytes(first + second[:-12])          # the run was killed while writing its last member
    scanned = raw.fill_rows(raw.raw_scan(spark, str(tmp_path / "raw"))).orderBy("tid").collect()
    assert [(r.tid, r.liquidated) for r in scanned][:2] == [(1, True), (2, False)]
    out = str(tmp_path / "out")
    assert tables.read_table(spark, out, "fills") is None
    assert tables.normalize_incremental(spark, str(tmp_path / "raw"), out) == {"fills": 0}      # still being written
    old = path.stat().st_mtime - 4000
    os.utime(path, (old, old))
    assert tables.normalize_incremental(spark, str(tmp_path / "raw"), out) == {"fills": 1}
    assert tables.normalize_incremental(spark, str(tmp_path / "raw"), out) == {"fills": 0}
    path.write_bytes(first + second)
    os.utime(path, (old + 60, old + 60))
    assert tables.normalize_incremental(spark, str(tmp_path / "raw"), out) == {"fills": 1}      # changed: replaced, not appended
    assert sorted(r.tid for r in tables.read_table(spark, out, "fills").collect()) == [1, 2, 3]


def test_damage_is_quarantined_and_read_again_when_mended(spark, tmp_path):
    folder = tmp_path / "raw" / "fills" / "date=2026-01-01"
    folder.mkdir(parents=True)
    text = "".join(envelope("0xA", [fill(i)]) + "\n" for i in range(2000)).encode()
    good = gzip.compress(text)
    bad = bytearray(good)
    bad[len(bad) // 2] ^= 0xFF
    (folder / "whole.jsonl.gz").write_bytes(gzip.compress((envelope("0xB", [fill(7)]) + "\n").encode()) + b"\0" * 20)
    (folder / "flipped.jsonl.gz").write_bytes(bytes(bad))
    (folder / "text.jsonl.gz").write_bytes(b"no gzip at all")
    (folder / "cut.jsonl.gz").write_bytes(good[:len(good) // 2])
    states = {r.path.rpartition("/")[2].split(".")[0]: r.state for r in raw.gzip_states(spark, str(tmp_path / "raw")).collect()}
    assert states == {"whole": "whole", "flipped": "damaged", "text": "damaged", "cut": "truncated"}
    out, run = str(tmp_path / "out"), lambda: tables.normalize_incremental(spark, str(tmp_path / "raw"), out, ["fills"], -60)
    run()
    users = lambda: {r.run: r.n for r in tables.read_table(spark, out, "fills").groupBy("run").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert users()["whole"] == 1 and 0 < users()["cut"] < 2000 and set(users()) == {"whole", "cut"}
    reasons = {(r.path.rpartition("/")[2], r.reason) for r in spark.read.parquet(f"{out}/{tables.QUARANTINE}/fills").collect()}
    assert reasons >= {("flipped.jsonl.gz", "damaged file"), ("text.jsonl.gz", "damaged file")}
    (folder / "flipped.jsonl.gz").write_bytes(good)
    (folder / "text.jsonl.gz").unlink()
    run()
    assert users()["flipped"] == 2000 and run() == {"fills": 0}


def test_stream_ingest_reads_files_that_grow(spark, tmp_path):
    folder = tmp_path / "raw" / "fills" / "date=2026-01-01"
    folder.mkdir(parents=True)
    path, out = folder / "r.jsonl.gz", str(tmp_path / "out")
    one, two = (gzip.compress((envelope("0xA", [fill(i)]) + "\n").encode()) for i in (1, 2))
    ingest = lambda settle: jobs.stream_ingest(spark, str(tmp_path / "raw" / "fills"), "fills", out, str(tmp_path / "log"), settle_seconds=settle).awaitTermination()
    path.write_bytes(one)
    ingest(300)
    assert tables.read_table(spark, out, "fills") is None       # it may still be written
    ingest(-60)
    assert [r.tid for r in tables.read_table(spark, out, "fills").collect()] == [1]
    path.write_bytes(one + two)
    later = path.stat().st_mtime + 5
    os.utime(path, (later, later))
    ingest(-60)
    assert sorted(r.tid for r in tables.read_table(spark, out, "fills").collect()) == [1, 2]


def test_repeated_keys_keep_the_last_value(spark):
    series = {"accountValueHistory": [[5, "1.0"], [6, "2.0"]], "pnlHistory": [[5, "10"], [6, "20"], [5, "30"]]}
    lines = [envelope("0xA", [["day", series]]), envelope("0xA", [["day", {"accountValueHistory": [[1, "1"]], "pnlHistory": []}]])]
    rows = raw.equity_rows(raw.parse_records(spark.createDataFrame([(x,) for x in lines], "value string"))).collect()
    assert sorted((r.time_ms, r.pnl) for r in rows if r.time_ms > 1) == [(5, 30.0), (6, 20.0)] and [r.pnl for r in rows if r.time_ms == 1] == [None]
    board = {"leaderboardRows": [{"ethAddress": "0xA", "accountValue": "1", "windowPerformances": [["day", {"pnl": "1", "roi": "2"}], ["week", {"pnl": "3"}], ["Day", {"pnl": "4"}]]}]}
    r = raw.leaderboard_rows(raw.parse_records(spark.createDataFrame([(envelope("0xA", board),)], "value string"))).collect()[0]
    assert (r.day_pnl, r.day_roi, r.week_pnl) == (4.0, None, 3.0)


def test_stream_ingest_quarantines(spark, tmp_path):
    folder = tmp_path / "raw" / "fills" / "date=2026-01-01"
    folder.mkdir(parents=True)
    (folder / "r.jsonl.gz").write_bytes(gzip.compress((envelope("0xA", [fill(1)]) + '\n{"platform": "p", "payl').encode()))
    jobs.stream_ingest(spark, str(tmp_path / "raw" / "fills"), "fills", str(tmp_path / "out"), str(tmp_path / "log"),
                       str(tmp_path / "bad"), settle_seconds=-60).awaitTermination()
    assert [r.tid for r in tables.read_table(spark, str(tmp_path / "out"), "fills").collect()] == [1]
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_blocks_of_a_large_group_grow(spark):
    members = spark.range(3000).selectExpr("if(id < 2900, 'large', 'small') as grp", "id as user")
    assert {r.grp: r._size for r in G.block_sizes(members, 4).collect()} == {"large": 91, "small": 4}
    assert {r._size for r in G.block_sizes(members, 5000).collect()} == {5000}
