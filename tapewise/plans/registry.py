"""Query registry: name -> Spark query over a table folder, and the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fit_tasks, path_bytes
from .fixtures import FIXTURES, TABLES, duck_fixture, spark_fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


class Tables:
    """The adaptors of one table folder, by name: t.fx_equity, t.fx_fills, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        # Dates and grids are UTC; the given timestamps carry no zone.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        fit_tasks(spark, sum(path_bytes(spark, f"{sf_dir}/{name}.parquet") for name in TABLES))

    def __getattr__(self, name: str) -> DataFrame:
        return spark_fixture(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def shown(df: DataFrame, columns: str) -> DataFrame:
    """The named columns; ~name is rounded to six digits, ~~name (large running sums) to three: sums of
    floating numbers depend on their order."""
    out = []
    for c in columns.split():
        name, digits = _digits(c)
        out.append(F.col(name) if digits is None else
                   (F.round(F.col(name).cast("double"), digits) + F.lit(0.0)).alias(name))
    return df.select(*out)


def _digits(column: str) -> tuple[str, int | None]:
    name = column.lstrip("~")
    return name, {0: None, 1: 6, 2: 3}[len(column) - len(name)]


def query(name: str, columns: str, sql: str | None = None):
    """Register fn(tables) -> DataFrame. `columns` are shown by the query and the SQL alike; `sql` is a
    FROM clause over the named common table expressions."""
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: shown(fn(Tables(spark, sf_dir)), columns)
        if sql is not None:
            ORACLES[name] = oracle(columns, sql)
        return fn
    return wrap


def cte(**definitions: str) -> None:
    CTES.update(definitions)


def oracle(columns: str, source: str) -> str:
    """SQL text: the expressions `source` needs, in dependency order, and the shown columns."""
    ordered: list[str] = []

    def need(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"(?:^|\b(?:from|join)\s+)([a-z_]\w*)", text)):
            if (word in CTES or word in FIXTURES) and word not in ordered:
                if word in CTES:
                    need(CTES[word])
                ordered.append(word)

    need(source)
    parts = [f"{w} as ({CTES[w] if w in CTES else duck_fixture(w)})" for w in ordered]
    cols = ", ".join(f'"{n}"' if d is None else f'round("{n}", {d}) + 0e0 as "{n}"' for n, d in map(_digits, columns.split()))
    head = f"with {', '.join(parts)} " if parts else ""
    return f"{head}select {cols} from {source}"
