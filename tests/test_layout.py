"""Stored layouts: the ordered scans read them without a shuffle and give the rows of the plain ones."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from tapewise.functions import scan as S
from tapewise.operators import behavior as H
from tapewise.sources.layout import Layout, open_layout, write_layout

from test_trading import FILLS, tape


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())


def stored(spark, df, layout):
    name = f"t_{uuid.uuid4().hex[:12]}"
    return name, write_layout(df, name, layout)


@pytest.mark.parametrize("rows", [10_000, 300, 9])
def test_trips_of_a_stored_table(spark, rows):
    perp = H.perp_fills(spark.createDataFrame(tape(1), FILLS))
    layout = Layout(("user",), H.ORDER, 3, rows)
    name, path = stored(spark, perp, layout)
    table = open_layout(spark, name, layout, path)
    assert (table.hot is None) == (rows == 10_000)
    if table.hot is None:
        assert "Exchange" not in plan(H.trips_of(table.cold, None))
    assert rows_of(H.trips_of(table.cold, table.hot)) == rows_of(H.round_trips(perp))
    # Another session's catalog does not know the table: the files are enough.
    spark.sql(f"drop table {name}")
    again = open_layout(spark, name, layout, path)
    assert again.cold.count() + (again.hot.count() if again.hot else 0) == perp.count()
    assert "Exchange" not in plan(H.trips_of(again.cold, None))
    spark.sql(f"drop table {name}")


@pytest.mark.parametrize("rows", [10_000, 100])
def test_as_of_over_a_stored_timeline(spark, rows):
    r = random.Random(2)
    users = ["hot"] * 8 + ["a", "b", None]
    left = spark.createDataFrame([(r.choice(users), r.randrange(500), i) for i in range(400)], "user string, at long, n long")
    right = spark.createDataFrame(sorted({(u, r.randrange(500)) for u in ("hot", "a", "c") for _ in range(60)}), "user string, t long").withColumn("v", F.col("t") * 2.0)
    both = {"backward": "b_", "forward": "f_"}
    layout = Layout(("user",), S.TIMELINE_ORDER, 3, rows)
    name, path = stored(spark, S.timeline(left, right, ["user"], "at", "t", ["v"]), layout)
    table = open_layout(spark, name, layout, path)
    got = S.asof_timeline(table.cold, table.hot, ["user"], both, 20)
    assert (table.hot is None) == (rows == 10_000)
    if table.hot is None:
        assert "Exchange" not in plan(got)
    assert rows_of(got) == rows_of(S.asof(left, right, ["user"], "at", "t", ["v"], both, 20)) and got.count() == 400
    spark.sql(f"drop table {name}")


def test_an_empty_table_can_be_stored(spark):
    empty = H.perp_fills(spark.createDataFrame([], FILLS))
    layout = Layout(("user",), H.ORDER, 2)
    name, path = stored(spark, empty, layout)
    table = open_layout(spark, name, layout, path)
    assert table.hot is None and H.trips_of(table.cold, table.hot).count() == 0
    spark.sql(f"drop table {name}")


def test_large_tables_get_more_buckets():
    layout = Layout(("user",), H.ORDER, 8)
    assert layout.fitting(4_000_000) == layout and layout.fitting(4_000_001).buckets == 9 and layout.fitting(10 ** 9).buckets == 2000
