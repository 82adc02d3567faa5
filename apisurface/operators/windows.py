"""Ordered operators: last definition, ordinals, curves, markers and sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apisurface import schemas as S
from apisurface.skew import last_before, running_sum, running_sums


def last_definition(
    uses: DataFrame,
    defs: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fields: Sequence[str],
    ignored: Column | None = None,
    is_null: Column | None = None,
    initial: Column | None = None,
    bucket: Column | None = None,
    bucketed: bool = True,
) -> DataFrame:
    """Each use with the latest definition strictly before it, per key in source order.

    ``ignored`` marks definitions that do not count. A definition for which ``is_null`` holds does win
    and makes ``usable`` false, as does having no definition at all. ``initial`` marks initializers: where no other
    definition comes before a use, the key's initializer (the last in order) counts, wherever the two stand. Rows of both kinds
    are put in one order; a hot variable is processed part by part unless ``bucketed`` is false.
    """
    keys, order, fields = list(keys), list(order), list(fields)
    counted = defs if ignored is None else defs.where(~F.coalesce(ignored, F.lit(False)))
    null_flag = F.lit(False) if is_null is None else F.coalesce(is_null, F.lit(False))
    definition = F.struct(*[F.col(f) for f in fields], null_flag.alias("_null"))
    first = F.lit(False) if initial is None else F.coalesce(initial, F.lit(False))
    right = counted.where(~first).select(*keys, *order, definition.alias("_def"))
    extra = [c for c in uses.columns if c not in (*keys, *order)]
    left = uses.select(*keys, *order, F.struct(F.lit(1).alias("_use"), *extra).alias("_row"))
    rows = left.unionByName(right, allowMissingColumns=True)
    # A definition at the very position of the use is not before it.
    rows = rows.withColumn("_rank", F.when(F.col("_row").isNotNull(), 0).otherwise(1))
    seen = last_before(rows, keys, [*order, "_rank"], F.col("_def"), "_last", bucket, bucketed)
    kept = seen.where(F.col("_row").isNotNull())
    if initial is not None:
        seeds = counted.where(first).groupBy(*keys).agg(F.max_by(definition, F.struct(*order)).alias("_seed"))
        kept = kept.join(seeds, keys, "left").withColumn("_last", F.coalesce("_last", "_seed"))
    return kept.select(
        *keys,
        *order,
        *[F.col("_row").getField(c).alias(c) for c in extra],
        *[F.col("_last").getField(f).alias(f"def_{f}" if f in extra or f in order else f) for f in fields],
        (F.col("_last").isNotNull() & ~F.coalesce(F.col("_last._null"), F.lit(True))).alias("usable"),
    )


def with_ordinal(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    start: int = 0,
    out: str = "ordinal",
    bucket: Column | None = None,
    bucketed: bool = True,
) -> DataFrame:
    """Position of each row within its group; ``order`` must be unique there.

    ``bucketed=False`` is for groups that are small by nature, such as the overloads of a function.
    """
    numbered = running_sum(df, list(by), list(order), F.lit(1), "_n", bucket=bucket, bucketed=bucketed)
    return numbered.withColumn(out, F.col("_n") - F.lit(1 - start)).drop("_n")


def ecdf(df: DataFrame, col: str, by: Sequence[str] = (), quantile: float = 0.90) -> DataFrame:
    """Count and cumulative count per distinct value; ``is_point`` marks the value at the quantile.

    Equal values are counted first. The running sum is taken per part of the values plus a carry.
    """
    by = list(by)
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    curve = running_sum(counts, by, [col], F.col("n"), "cumulative")
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    if by:
        same = F.lit(True)
        for name in by:
            same = same & F.col(f"c.{name}").eqNullSafe(F.col(f"t.{name}"))
        joined = curve.alias("c").join(totals.alias("t"), same).select("c.*", "t._total")
    else:
        joined = curve.withColumn("_total", totals.scalar())
    rank = F.floor((F.col("_total") - 1).cast("double") * F.lit(float(quantile)))
    at = (rank < F.col("cumulative")) & (rank >= F.col("cumulative") - F.col("n"))
    return joined.withColumn("is_point", at).drop("_total")


def with_markers(
    args: DataFrame, by: Sequence[str], order: Sequence[str], kind: str = "kind", bucket: Column | None = None
) -> DataFrame:
    """Argument rows with ``slash_before``, ``star_before`` and ``slash_after``.

    ``/`` follows the leading positional-only arguments; ``*`` precedes the first keyword-only one unless
    a variadic argument came earlier. All counts are running sums over the argument order.
    """
    by, order = list(by), list(order)

    def flag(value: str) -> Column:
        return F.when(F.col(kind) == value, 1).otherwise(0)

    sums = {
        "_others": (1 - flag(S.POSITIONAL_ONLY), True),
        "_leading": (flag(S.POSITIONAL_ONLY), False),
        "_keyword": (flag(S.KEYWORD_ONLY), True),
        "_variadic": (flag(S.VAR_POSITIONAL), False),
        "_position": (F.lit(1), True),
    }
    rows = running_sums(args, by, order, sums, bucket)
    size = args.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    same = F.lit(True)
    for name in by:
        same = same & F.col(f"a.{name}").eqNullSafe(F.col(f"s.{name}"))
    rows = rows.alias("a").join(size.alias("s"), same).select("a.*", "s._size")
    is_other = F.col(kind) != S.POSITIONAL_ONLY
    return rows.select(
        *args.columns,
        (is_other & (F.col("_others") == 1) & (F.col("_leading") > 0)).alias("slash_before"),
        ((F.col(kind) == S.KEYWORD_ONLY) & (F.col("_keyword") == 1) & (F.col("_variadic") == 0)).alias("star_before"),
        ((F.col("_others") == 0) & (F.col("_position") == F.col("_size"))).alias("slash_after"),
    )


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "first") -> DataFrame:
    """One row per key, first or last in ``order``; combined map-side, so hot keys stay cheap."""
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be first or last, not {keep!r}")
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if keep == "first" else F.max_by
    chosen = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(chosen).select(*keys, "_row.*").select(*df.columns)


def with_section(
    tokens: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    optional: Column,
    keyword: Column | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """Section of each token: required, optional after the first ``|``, keyword_only after ``$``."""
    sums = {"optional_marks": (F.when(optional, 1).otherwise(0), True)}
    if keyword is not None:
        sums["keyword_marks"] = (F.when(keyword, 1).otherwise(0), True)
    rows = running_sums(tokens, list(by), list(order), sums, bucket)
    marks = F.lit(0) if keyword is None else F.col("keyword_marks")
    section = F.when(marks > 0, F.lit("keyword_only")).when(F.col("optional_marks") > 0, F.lit("optional"))
    return rows.withColumn("section", section.otherwise(F.lit("required")))
