"""Exact places in a total order, found by many tasks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apisurface.session import shared_folder

#: ``monotonically_increasing_id`` holds the place of a row within its partition in so many lower bits.
PLACE_BITS = (1 << 33) - 1


def with_global_rank(df: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """``df`` with the place of each row, from 0, in the order of ``order``; which of equal rows comes first is open.

    Rows are dealt to ranges of the order, sorted there and written once with their place in the range, so a task that runs again sees the
    same; a range then starts where the counts of those before it end. Only one count per range comes to the driver. Add a
    salt to ``order`` where very many rows may be equal in it. An empty table stays empty.
    """
    part, place, start = (f"_{n}_{uuid.uuid4().hex[:8]}" for n in ("part", "place", "start"))
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id().bitwiseAND(PLACE_BITS)
    path = shared_folder(df.sparkSession, "ranked")
    dealt.select("*", F.spark_partition_id().alias(part), within.alias(place)).write.parquet(path)
    kept = df.sparkSession.read.parquet(path)
    starts, total = [], 0
    for row in sorted(kept.groupBy(part).count().collect()):
        starts.append((row[0], total))
        total += row[1]
    begun = df.sparkSession.createDataFrame(starts, f"{part} int, {start} long")
    # One row of two numbers for each range.
    ranked = kept.join(F.broadcast(begun), part)
    return ranked.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(start) + F.col(place)).alias(name))
