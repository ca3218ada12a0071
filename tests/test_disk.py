"""What is shuffled and written at all: rows that lie together by user are not dealt out again, nor written to be counted."""

import pytest
from pyspark.sql import functions as F

from tapewise.functions import ranks as K
from tapewise.operators import behavior as H
from tapewise.operators import risk as G
from tapewise.operators.latest import dedup_equity
from tapewise.operators.returns import daily_pnl_returns
from tapewise.session import shared
from tapewise.sources.layout import Layout, open_layout, write_layout

FILL = ("user string, time_ms long, coin string, side string, dir string, px double, sz double, start_position double, "
        "closed_pnl double, fee double, liquidated boolean, oid long, tid long")
EQUITY = "user string, period string, time_ms long, account_value double, pnl double"


def tape(spark):
    """Two users, two coins, flips, copies that differ, a spot fill and rows without a user or an id."""
    rows, cycle = [], ((2.0, 0.0, "Open Long"), (-5.0, 2.0, "Long > Short"), (3.0, -3.0, "Close Short"))
    for u in ("a", "b"):
        for i in range(60):
            size, start, name = cycle[i % 3]
            rows.append((u, 1_000 * (i // 2), f"C{i // 3 % 2}", "B" if size > 0 else "A", name, 10.0 + i % 7, abs(size), start, 0.5 * (i % 3), 0.1, i % 11 == 0, i % 5, i))
    rows += [r[:5] + (r[5] + 1,) + r[6:] for r in rows[::4]]
    rows += [("a", 5, "PURR/USDC", "B", "Buy", 1.0, 1.0, 0.0, 0.0, 0.0, False, 1, 900), (None, 7, "C0", "B", "Open Long", 1.0, 1.0, 0.0, 0.0, 0.0, None, 1, None)]
    return spark.createDataFrame(rows, FILL).repartition(3)


def curve(spark):
    return spark.createDataFrame([(u, p, t * 1_000, 100.0 + t, float(t)) for u in "ab" for p in ("allTime", "month") for t in range(0, 30, 7)] * 2, EQUITY)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(df.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes]).collect(), key=str)


def test_round_trips_take_one_shuffle_of_the_fills(spark):
    fills = tape(spark)
    counts = H.leg_counts(fills)
    got = H.round_trips(H.perp_by_user(fills, counts), counts=counts)
    assert plan(got).count("Exchange hashpartitioning") == 1
    want = rows_of(H.round_trips(H.perp_fills(fills)))
    assert rows_of(got) == want and len(want) > 20
    hot = H.perp_by_user(fills, counts, rows=10)        # hot users: dealt out finely and written
    assert "FileScan" in plan(hot) and rows_of(H.round_trips(hot, 10, counts)) == want


def test_a_layout_is_written_from_the_shuffle_that_deduplicates(spark):
    fills, layout = tape(spark), Layout(("user",), H.ORDER, 3)
    counts = H.leg_counts(fills)
    perp = H.perp_by_user(fills, counts, layout.buckets)
    assert plan(perp).count("Exchange hashpartitioning(user") == 1
    spark.sql("drop table if exists disk_perp")
    path = write_layout(perp, "disk_perp", layout, counts=counts)
    stored = open_layout(spark, "disk_perp", layout, path)
    files = [f for f in spark.table("disk_perp").inputFiles()]
    assert len(files) <= layout.buckets and stored.hot is None
    got = H.trips_of(stored.cold, stored.hot)
    assert "Exchange" not in plan(got) and rows_of(got) == rows_of(H.round_trips(H.perp_fills(fills)))
    spark.sql("drop table disk_perp")


@pytest.mark.parametrize("rows", [1_000, 150, 10])
def test_exposure_of_ordinary_users_meets_the_equity_without_a_shuffle_of_fills(spark, rows):
    """1,000: nobody is hot; 150: fills are not, with the equity some are; 10: all are."""
    fills, equity = tape(spark), curve(spark)
    counts = H.leg_counts(fills)
    got = H.gross_exposure(H.perp_by_user(fills, counts, rows=rows), equity, rows, counts=counts)
    if rows == 1_000:
        assert plan(got).count("Exchange hashpartitioning(user") == 2      # the fills and the equity, once each
    assert rows_of(got) == rows_of(H.gross_exposure(H.perp_fills(fills), equity))


def test_equity_that_lies_by_user_is_not_dealt_out_again(spark):
    equity = curve(spark)
    by_user = dedup_equity(equity.repartition("user"))
    assert plan(by_user).count("Exchange") == 1 and "Exchange hashpartitioning(user" in plan(by_user)
    assert plan(daily_pnl_returns(by_user)).count("Exchange") == 1
    assert rows_of(by_user) == rows_of(dedup_equity(equity.repartition(3))) == rows_of(equity.distinct())


def test_shuffle_files_go_when_a_shared_table_is_written(spark):
    files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles
    kept = lambda: {f.getName() for f in (files().apply(i) for i in range(files().size())) if f.getName().startswith("shuffle_")}
    frame = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before = kept()
    table = shared(frame)
    assert kept() <= before and table.count() == 7


def test_ranks_of_a_joined_frame_are_counted_before_the_join(spark):
    both = shared(spark.range(200).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 11).cast("double").alias("sig"),
                                          F.when(F.col("id") % 13 > 0, F.col("id") * 5 % 17).cast("double").alias("out")))
    first = K.ranked(both, ["k"], "sig", rank="r")
    once, twice = K.ranked(first, ["k"], "out", rank="s", counted=both), K.ranked(first, ["k"], "out", rank="s")
    assert plan(once).count("FileScan") < plan(twice).count("FileScan")
    assert rows_of(once) == rows_of(twice)


def test_returns_that_lie_by_user_are_packed_without_a_shuffle(spark):
    equity = curve(spark).withColumn("time_ms", F.col("time_ms") * 86_400)      # days, not seconds
    daily = daily_pnl_returns(dedup_equity(equity.repartition("user")), min_prev=0.0)
    packed = G.packed_returns(daily, by_user=True)
    assert plan(packed).count("Exchange") == 1
    assert rows_of(packed) == rows_of(G.packed_returns(daily)) and packed.count() == 2
