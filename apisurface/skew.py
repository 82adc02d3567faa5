"""Running aggregates that stay parallel when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from apisurface.ordered import with_global_rank

#: Rows of one part. A table of no more rows is worked on key by key, as no key can hold more than that.
PART_ROWS = 1_000_000


def _parts(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column | None) -> DataFrame | None:
    """``df`` with ``_part``: the keys and a number that grows along ``order``; null if every key is small anyway.

    Without ``bucket``, the number counts off ``PART_ROWS`` rows in the order of keys and ``order``, so parts are even
    for any type and any values, outliers and equal values included.
    """
    names = [F.col(k) for k in keys]
    if bucket is not None:
        return df.withColumn("_part", F.struct(*names, bucket.alias("_bucket")))
    if df.count() <= PART_ROWS:
        return None
    ranked = with_global_rank(df, [*keys, *order], "_place_in_all")
    number = F.floor(F.col("_place_in_all") / PART_ROWS)
    return ranked.withColumn("_part", F.struct(*names, number.alias("_bucket"))).drop("_place_in_all")


def _carried(totals: DataFrame, keys: Sequence[str], carries: dict[str, Column]) -> DataFrame:
    """Carry of all earlier parts of the same key; one row per part."""
    groups = [F.col("_part").getField(k) for k in keys]
    before = (
        Window.partitionBy(*groups)
        .orderBy(F.col("_part").getField("_bucket").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return totals.select("_part", *[carry.over(before).alias(name) for name, carry in carries.items()])


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, tuple[Column, bool]],
    bucket: Column | None = None,
    bucketed: bool = True,
) -> DataFrame:
    """Running sums per key in ``order``, computed per part of a key plus a carry.

    ``sums`` maps a new column to its value and whether the current row counts. No task sorts more of a key than
    ``PART_ROWS`` rows, and only one row per part takes part in the window over the key. A ``bucket`` given instead must
    keep the first order column's order. ``bucketed=False`` is for keys that are small by nature, such as one function: a
    plain window, one shuffle.
    """
    zero = F.lit(0)

    def local(window: WindowSpec, value: Column, include_current: bool) -> Column:
        frame = window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
        return F.coalesce(F.sum(value).over(frame), zero)

    parts = _parts(df, keys, order, bucket) if bucketed else None
    if parts is None:
        whole = Window.partitionBy(*keys)
        return df.select("*", *[local(whole, v, current).alias(n) for n, (v, current) in sums.items()])
    inside = Window.partitionBy("_part")
    totals = parts.groupBy("_part").agg(*[F.sum(v).alias(f"_total_{n}") for n, (v, _) in sums.items()])
    carries = _carried(totals, keys, {f"_carry_{n}": F.sum(f"_total_{n}") for n in sums})
    running = parts.select("*", *[local(inside, v, current).alias(f"_inside_{n}") for n, (v, current) in sums.items()])
    return running.join(carries, "_part", "left").select(
        *df.columns,
        *[(F.col(f"_inside_{n}") + F.coalesce(F.col(f"_carry_{n}"), zero)).alias(n) for n in sums],
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    include_current: bool = True,
    bucket: Column | None = None,
    bucketed: bool = True,
) -> DataFrame:
    """One running sum; see ``running_sums``."""
    return running_sums(df, keys, order, {out: (value, include_current)}, bucket, bucketed)


def last_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    bucket: Column | None = None,
    bucketed: bool = True,
) -> DataFrame:
    """Last non-null ``value`` strictly before each row of the same key, part by part.

    ``bucketed=False`` is for keys that are small by nature.
    """
    parts = _parts(df, keys, order, bucket) if bucketed else None
    if parts is None:
        before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.last(value, ignorenulls=True).over(before))
    parts = parts.withColumn("_value", value)
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = (
        parts.where(F.col("_value").isNotNull())
        .groupBy("_part")
        .agg(F.max_by("_value", F.struct(*order)).alias("_total"))
    )
    # Parts without a value of their own need a carry as well.
    buckets = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    totals = buckets.join(last, "_part", "left")
    offsets = _carried(totals, keys, {"_carry": F.last("_total", ignorenulls=True)})
    return (
        parts.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside))
        .join(offsets, "_part", "left")
        .withColumn(out, F.coalesce("_inside", "_carry"))
        .drop("_part", "_value", "_inside", "_carry")
    )
