"""Registered queries: operators bound to the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one folder as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def bound(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is its equivalent on the same tables."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


#: Rows of one task where each takes a costly expression.
ROWS_A_TASK = 50_000


def spread(df: DataFrame) -> DataFrame:
    """A table dealt to all cores, for costly expressions over each row: a row group, however many rows it has, is one task."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK))
    return df.repartition(tasks)


def text(flag):
    """Boolean as text."""
    return F.when(flag, F.lit("true")).otherwise(F.lit("false"))


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LINE_ORDER_SQL = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def ordered_lines(t: Tables, *fields, **named) -> DataFrame:
    """Lines of each order as one ordered array; an order has a handful of lines."""
    extra = [F.col(f) for f in fields if f not in LINE_ORDER] + [v.alias(k) for k, v in named.items()]
    line = F.struct(*LINE_ORDER, *extra)
    return t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
