"""Small helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from apisurface.batches import TEXT_ROWS, in_arrow, sliced
from apisurface.session import shared_folder


__all__ = ["TEXT_ROWS", "fresh", "in_arrow", "pick", "sliced", "stored", "table"]


def pick(df: DataFrame, **names: str) -> DataFrame:
    """``df`` cut to the named columns under new names; other columns, whatever they are called, are left behind."""
    return df.select(*[df[f"`{source}`"].alias(name) for name, source in names.items()])


#: Whether shuffle files go when the query that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: no lineage, safe from lost executors.

    What was shuffled for it goes at once, not when the driver happens to collect garbage. The session's settings stay as they are.
    """
    spark = df.sparkSession
    path = shared_folder(spark, label)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh(prefix: str, taken: Sequence[str]) -> str:
    """A column name that is not among ``taken``."""
    return prefix if prefix not in taken else f"{prefix}_{uuid.uuid4().hex[:8]}"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a test folder."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
