"""A sample of at most a given number of rows, the same in every run, that no hot key can blow up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apisurface.llm.frames import fresh

SPAN = 1 << 63


def hash_place(keys: Sequence[str]) -> F.Column:
    """A number from 0 to 2^63 - 1 that the values of ``keys`` alone decide."""
    return F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), 1)


def share_cut(n: int, total: int) -> int:
    """The place below which some ``1.2 * n`` of about ``total`` different rows lie, so that ``n`` are all but surely among them."""
    return min(SPAN - 1, int(SPAN * (1.2 * n + 50) / max(total, 1)))


def bounded_sample(rows: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """At most ``n`` rows of ``rows``, those of smallest hash of ``keys``; rows equal in ``keys`` count once.

    Different keys are counted by a sketch; only about ``1.2 * n`` rows go on to the one task that cuts exactly.
    No rows give no rows.
    """
    place = fresh("_place", rows.columns)
    placed = rows.withColumn(place, hash_place(keys))
    total = placed.agg(F.approx_count_distinct(place, 0.03)).first()[0]
    near = placed.where(F.col(place) <= share_cut(n, total)).dropDuplicates([place])
    return near.orderBy(place).limit(n).drop(place)
