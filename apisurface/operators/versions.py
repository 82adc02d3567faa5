"""Comparison of two catalog versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apisurface.session import cut_lineage

CHANGES = ["added", "removed", "changed", "unchanged"]


def diff_catalogs(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str] = ("function_id", "signature_index"),
    compare: Sequence[str] = ("signature",),
    carry: Sequence[str] = (),
) -> DataFrame:
    """Full outer match on the keys with the change kind and both versions of the compared columns.

    Keys are unique in each catalog, so the join has no hot key.
    """
    keys, compare, carry = list(keys), list(compare), list(carry)
    left = a.select(*keys, *[F.col(c).alias(f"old_{c}") for c in (*compare, *carry)], F.lit(True).alias("_in_a"))
    right = b.select(*keys, *[F.col(c).alias(f"new_{c}") for c in (*compare, *carry)], F.lit(True).alias("_in_b"))
    same = F.lit(True)
    for c in compare:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    change = (
        F.when(F.col("_in_a").isNull(), F.lit("added"))
        .when(F.col("_in_b").isNull(), F.lit("removed"))
        .when(same, F.lit("unchanged"))
        .otherwise(F.lit("changed"))
    )
    joined = left.join(right, keys, "full_outer").withColumn("change", change)
    carried = [F.coalesce(f"new_{c}", f"old_{c}").alias(c) for c in carry]
    pairs = [F.col(f"{side}_{c}") for c in compare for side in ("old", "new")]
    return joined.select(*keys, *carried, *pairs, "change")


def diff_grouped(
    a: DataFrame,
    b: DataFrame,
    group: str = "module_name",
    keys: Sequence[str] = ("function_id", "signature_index"),
    compare: Sequence[str] = ("signature",),
    carry: Sequence[str] = (),
) -> DataFrame:
    """``diff_catalogs`` that matches rows of changed groups only.

    Each version is first reduced to a digest per group: its number of rows and two sums of row hashes, which do not depend on order
    and combine map-side. Rows of groups whose digests agree are unchanged as they stand and are not shuffled; only
    the others are matched by key. A key that moves from one group to another changes both. ``group`` is carried.
    """
    keys, compare, carry = list(keys), list(compare), [c for c in carry if c != group]
    hashed = [*keys, *compare, *carry, group]

    def digests(df: DataFrame, side: str) -> DataFrame:
        sums = [F.sum(F.xxhash64(F.lit(salt), *[F.col(c) for c in hashed]).cast("decimal(20,0)")) for salt in (1, 2)]
        return df.groupBy(F.col(group).alias(f"_{side}")).agg(F.struct(F.count(F.lit(1)).alias("n"), *[h.alias(f"h{i}") for i, h in enumerate(sums)]).alias(f"_{side}_digest"))

    old, new = digests(a, "old"), digests(b, "new")
    matched = old.join(new, old["_old"].eqNullSafe(new["_new"]), "full_outer")
    differs = matched.where(~F.col("_old_digest").eqNullSafe(F.col("_new_digest")))
    changed = cut_lineage(differs.select(F.coalesce("_old", "_new").alias("_changed")).distinct())
    hit = F.col(group).eqNullSafe(F.col("_changed"))
    match = diff_catalogs(a.join(changed, hit, "left_semi"), b.join(changed, hit, "left_semi"), keys, compare, [*carry, group])
    same = b.join(changed, hit, "left_anti")
    pairs = [F.col(c).alias(f"{side}_{c}") for c in compare for side in ("old", "new")]
    kept = same.select(*keys, *carry, group, *pairs, F.lit("unchanged").alias("change"))
    return match.unionByName(kept)


def diff_summary(diff: DataFrame, by: str = "module_name") -> DataFrame:
    """Rows per change kind and module, zero-filled."""
    return diff.groupBy(by).agg(*[F.count_if(F.col("change") == c).alias(c) for c in CHANGES])
