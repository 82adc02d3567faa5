"""Counters, funnels, timing statistics and type unions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apisurface import schemas as S
from apisurface.functions.text import blank_to_null
from apisurface.functions.types import ANY, union_members, union_text
from apisurface.session import cut_lineage

UNKNOWN_PROVIDER = "<unknown>"
QUANTILES = {"p50": 0.50, "p90": 0.90, "p95": 0.95}


def completion_summary(df: DataFrame, provider: str = "provider", outcome: str = "outcome") -> DataFrame:
    """One row: total, c_extension, pybind11, failed. Unsupported rows are not counted."""
    done, failed = F.col(outcome) == "completed", F.col(outcome) == "failed"
    return df.agg(
        F.count_if(done | failed).alias("total"),
        F.count_if(done & (F.col(provider) == "c_extension")).alias("c_extension"),
        F.count_if(done & (F.col(provider) == "pybind11")).alias("pybind11"),
        F.count_if(failed).alias("failed"),
    )


def _percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100


def funnel(
    df: DataFrame,
    by: Sequence[str] = (),
    mapping: str = "mapping_status",
    parameter: str = "parameter_inference_status",
    returned: str = "return_inference_status",
) -> DataFrame:
    """Mapping rate over all rows; inference rates over mapped rows; null when nothing was mapped."""

    def good(name: str) -> Column:
        return F.coalesce(F.col(name) == "success", F.lit(False))

    mapped = good(mapping)
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_functions"),
        F.count_if(mapped).alias("mapping_success"),
        F.count_if(mapped & good(parameter)).alias("parameter_success"),
        F.count_if(mapped & good(returned)).alias("return_success"),
        F.count_if(mapped & good(parameter) & good(returned)).alias("both_success"),
    )
    base = F.col("mapping_success")
    return counts.withColumns(
        {
            "mapping_rate": _percent(base, F.col("total_functions")),
            "parameter_rate": _percent(F.col("parameter_success"), base),
            "return_rate": _percent(F.col("return_success"), base),
            "both_rate": _percent(F.col("both_success"), base),
        }
    )


def provider_counts(df: DataFrame, provider: str = "provider") -> DataFrame:
    """Rows per provider; null and empty become ``<unknown>``."""
    label = F.coalesce(F.nullif(F.col(provider), F.lit("")), F.lit(UNKNOWN_PROVIDER))
    return df.groupBy(label.alias("provider")).agg(F.count(F.lit(1)).alias("functions"))


def code_counts(df: DataFrame, dims: Mapping[str, str], codes: Sequence = S.CODES) -> DataFrame:
    """Rows per dimension and code, zero-filled over the code domain.

    ``dims`` maps dimension names to columns. All cells are counted in one pass over the data and
    the single result row is then turned into rows.
    """
    cells = [(d, str(c), F.count_if(F.col(col) == c).alias(f"{d}|{c}")) for d, col in dims.items() for c in codes]
    row = df.agg(*[cell for _, _, cell in cells])
    entries = F.array(
        *[
            F.struct(F.lit(d).alias("dimension"), F.lit(c).alias("code"), F.col(f"`{d}|{c}`").alias("rows"))
            for d, c, _ in cells
        ]
    )
    return row.select(F.explode(entries).alias("e")).select("e.*")


def evaluation_summary(
    functions: DataFrame, evaluations: DataFrame, signatures: str = "signatures", status: str | None = None
) -> DataFrame:
    """Total signatures, evaluated rows and one column per dimension and code.

    With ``status`` only rows for which it is ``ok`` count as evaluated; the others are counted as ``error_rows``.
    """
    fine = F.lit(True) if status is None else F.col(status).eqNullSafe(F.lit("ok"))
    cells = [
        F.count_if(fine & (F.col(f"{d}_code") == c)).alias(f"{d}_{c}_count") for d in S.DIMENSIONS for c in S.CODES
    ]
    totals = functions.agg(F.coalesce(F.sum(F.coalesce(F.size(signatures), F.lit(0))), F.lit(0)).alias("total_signatures"))
    errors = [] if status is None else [F.count_if(~fine).alias("error_rows")]
    counted = evaluations.agg(F.count_if(fine).alias("evaluated_rows"), *errors, *cells)
    return counted.select(totals.scalar().alias("total_signatures"), "*")


#: Items a quantile sketch keeps at its lowest level; ranks from it are off by some 0.1 % of the rows.
SKETCH_ITEMS = 4000
#: Share of the rows on either side of an estimate among which the wanted value is looked for.
BRACKET = 0.004
#: Groups whose brackets, some hundred bytes each, every task may hold.
FEW_GROUPS = 10_000


def _level_groups(by: Sequence[str], total: bool) -> Column:
    """Groups a row counts for: that of its keys (level 0) and, if wanted, that of all rows (level 1)."""
    own = F.struct(*[F.col(b) for b in by], F.lit(0).alias("_level"))
    if not total:
        return F.array(own)
    return F.array(own, F.struct(*[F.when(F.lit(False), F.col(b)).alias(b) for b in by], F.lit(1).alias("_level")))


def _in_brackets(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """Exact values at the wanted ranks, as far as they lie in their brackets: ``_group``, ``name``, ``value``.

    Rows below a bracket are counted, map-side, only those inside are put in order.
    """

    def mark(b: Column) -> Column:
        below = b["low"].isNotNull() & (F.col("_d") < b["low"])
        inside = b["high"].isNull() | (F.col("_d") <= b["high"])
        told = F.when(below, F.col("_none")).when(inside, F.col("_value"))
        return F.when(below | inside, F.struct(b["name"].alias("name"), b["rank"].alias("rank"), told.alias("value")))

    joined = rows.where(F.col("_value").isNotNull()).withColumn("_none", F.when(F.lit(False), F.col("_value"))).join(brackets, "_group")
    marks = F.filter(F.transform("_brackets", mark), lambda m: m.isNotNull())
    counts = joined.select("_group", F.explode(marks).alias("m")).groupBy("_group", "m.name", "m.rank", "m.value").agg(F.count(F.lit(1)).alias("_n"))
    # Null stands for all rows below and comes first.
    upto = Window.partitionBy("_group", "name").orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_upto", F.sum("_n").over(upto))
    hit = F.col("value").isNotNull() & (F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("_n"))
    return placed.where(hit).select("_group", "name", "value")


def ranked_measures(
    df: DataFrame, col: str, quantiles: Mapping[str, float], by: Sequence[str] = (), measures: Sequence[Column] = (), total: bool = False
) -> DataFrame:
    """Per group, and with ``total`` for all rows: ``measures`` and exact values at rank ``floor((n - 1) * q)``, with ``_level``.

    One read makes the measures and a mergeable quantile sketch per group, which brackets each rank; a second read counts what lies
    below a bracket and puts in order what lies inside. Should a rank fall outside of its bracket, that one is looked for among
    all rows of its group.
    """
    d = F.col(col).cast("double")
    rows = df.withColumn("_group", F.explode(_level_groups(by, total))).withColumns({"_value": F.col(col), "_d": d})
    sketch = F.kll_sketch_agg_double(F.when(~F.isnan("_d"), F.col("_d")), SKETCH_ITEMS).alias("_sketch")
    first = rows.groupBy("_group").agg(F.count("_value").alias("_rows"), F.count_if(F.col("_value").isNotNull() & ~F.isnan("_d")).alias("_known"), sketch, *measures)
    # Few rows, and such as are no numbers, are put in order as they are.
    sketched = (F.col("_known") == F.col("_rows")) & (F.col("_rows") >= 4 / BRACKET)

    def edge(share: float) -> Column:
        inside = F.kll_sketch_get_quantile_double("_sketch", F.lit(share)) if 0 < share < 1 else F.lit(None).cast("double")
        return F.when(sketched, inside)

    brackets = F.array(
        *[
            F.struct(
                F.lit(n).alias("name"),
                F.floor((F.col("_rows") - 1).cast("double") * F.lit(float(q))).alias("rank"),
                edge(q - BRACKET).alias("low"),
                edge(q + BRACKET).alias("high"),
            )
            for n, q in quantiles.items()
        ]
    )
    names = [c for c in first.columns if c not in ("_group", "_rows", "_known", "_sketch")]
    told = cut_lineage(first.select("_group", "_rows", *names, brackets.alias("_brackets")))
    wanted = told.where(F.col("_rows") > 0).select("_group", "_brackets")
    # Few groups go to the rows, so that the rows of a large one stay spread.
    few = told.count() <= FEW_GROUPS
    found = cut_lineage(_in_brackets(rows.select("_group", "_value", "_d"), F.broadcast(wanted) if few else wanted))
    missed = wanted.select("_group", F.explode("_brackets").alias("b")).join(found.select("_group", F.col("name").alias("_name")), ["_group"], "left")
    missed = missed.groupBy("_group", "b").agg(F.bool_or(F.coalesce(F.col("_name") == F.col("b.name"), F.lit(False))).alias("_found")).where(~F.col("_found"))
    missed = cut_lineage(missed)
    if not missed.isEmpty():
        open_ = F.struct(F.col("b.name").alias("name"), F.col("b.rank").alias("rank"), F.when(F.lit(False), F.lit(0.0)).alias("low"), F.when(F.lit(False), F.lit(0.0)).alias("high"))
        again = missed.groupBy("_group").agg(F.collect_list(open_).alias("_brackets"))
        found = found.unionByName(_in_brackets(rows.select("_group", "_value", "_d"), F.broadcast(again) if few else again))
    values = found.groupBy("_group").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in quantiles])
    keys = [F.col("_group").getField(b).alias(b) for b in by]
    joined = told.join(values, "_group", "left")
    return joined.select(*keys, F.col("_group._level").alias("_level"), "_rows", *names, *quantiles)


def floor_percentiles(
    df: DataFrame, col: str, quantiles: Mapping[str, float] = QUANTILES, by: Sequence[str] = ()
) -> DataFrame:
    """Exact value at 0-based rank ``floor((n - 1) * q)`` of the sorted values, per group; groups of nulls alone have no row."""
    return ranked_measures(df, col, quantiles, by).where(F.col("_rows") > 0).select(*by, *quantiles)


def timing_measures(col: str, file: str | None) -> list[Column]:
    measures = [
        F.count(F.col(col)).alias("functions"),
        F.sum(col).alias("total"),
        F.avg(col).alias("avg"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
    ]
    return measures if file is None else [*measures, F.countDistinct(file).alias("files")]


def timing_summary(
    df: DataFrame,
    col: str,
    by: Sequence[str] = (),
    quantiles: Mapping[str, float] = QUANTILES,
    empty: str = "zeros",
    file: str | None = None,
) -> DataFrame:
    """Count, total, average, minimum, maximum and floor-rank percentiles per group.

    Without groups an empty input gives a row of zeros, or fails when ``empty="error"``.
    """
    by = list(by)
    measured = ranked_measures(df, col, quantiles, by, timing_measures(col, file))
    names = [c for c in measured.columns if c not in (*by, "_level", "_rows", *quantiles)]
    if by:
        return measured.select(*by, *names, *quantiles)
    row = measured.select(*names, *quantiles)
    nothing = df.limit(1).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 0)
    zeros = [F.lit(0).cast(t).alias(c) for c, t in row.dtypes]
    row = row.unionByName(nothing.select(*zeros))
    if empty == "error":
        return row.where(
            F.when(F.col("functions") > 0, F.lit(True)).otherwise(F.raise_error(F.lit("no rows to summarize")).cast("boolean"))
        )
    return row.fillna(0)


def timing_rollup(df: DataFrame, col: str, by: str, file: str | None = None, total: str = "<all>") -> DataFrame:
    """Statistics per library and, with ``is_total`` set, for all libraries together.

    The input is read twice: once for the measures and sketches of both levels, once for the percentiles.
    """
    measured = ranked_measures(df, col, QUANTILES, [by], timing_measures(col, file), total=True)
    is_total = F.col("_level") == 1
    name = F.lit(total).cast(df.schema[by].dataType)
    names = [c for c in measured.columns if c not in (by, "_level", "_rows", *QUANTILES)]

    def shown(c: str) -> Column:
        # A total of nothing is zeros.
        kept = c not in QUANTILES and c not in ("functions", "total", "avg", "min", "max")
        return F.col(c) if kept else F.when(is_total, F.coalesce(F.col(c), F.lit(0).cast(dict(measured.dtypes)[c]))).otherwise(F.col(c)).alias(c)

    rows = measured.select(F.when(is_total, name).otherwise(F.col(by)).alias(by), *[shown(c) for c in (*names, *QUANTILES)], is_total.alias("is_total"))
    empty = df.limit(1).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 0)
    zero = [F.lit(0).cast(t).alias(c) for c, t in rows.dtypes if c not in (by, "is_total")]
    return rows.unionByName(empty.select(name.alias(by), *zero, F.lit(True).alias("is_total")))


def union_types(df: DataFrame, by: Sequence[str], col: str, drop_none: bool = False, out: str = "type") -> DataFrame:
    """Canonical union of all type texts of a group, with the inference status.

    Types are reduced to distinct texts while they are combined, so a group never holds more than
    the distinct types. No type at all gives ``typing.Any`` with status ``failed``.
    """
    texts = F.collect_set(F.col(col))
    flat = F.flatten(F.transform(texts, union_members))
    merged = df.groupBy(*by).agg(union_text(flat, drop_none).alias("_union"))
    return merged.select(
        *by,
        F.coalesce("_union", F.lit(ANY)).alias(out),
        F.when(F.col("_union").isNull(), F.lit("failed")).otherwise(F.lit("success")).alias("status"),
    )


def module_imports(
    df: DataFrame, by: Sequence[str], imports: str, overload_count: Column | None = None, out: str = "imports"
) -> DataFrame:
    """Sorted distinct imports per module; a function with several signatures adds ``typing``."""
    own = F.coalesce(F.col(imports), F.array().cast("array<string>"))
    if overload_count is not None:
        own = F.when(overload_count > 1, F.array_union(own, F.array(F.lit("typing")))).otherwise(own)
    single = df.select(*by, F.explode_outer(own).alias("_import")).distinct()
    return single.groupBy(*by).agg(F.sort_array(F.collect_set("_import")).alias(out))


def type_coverage(hits: DataFrame, owner: str, kind: str = "type") -> DataFrame:
    """Owners per type, each counted once."""
    return hits.select(owner, kind).distinct().groupBy(kind).agg(F.count(F.lit(1)).alias("owners"))


def group_hits(hits: DataFrame, owner: str, kind: str = "type", keyword: str = "keyword") -> DataFrame:
    """Per owner the array of (type, keywords); both levels sorted, both bounded by the keyword list."""
    inner = hits.groupBy(owner, kind).agg(F.sort_array(F.collect_set(keyword)).alias("keywords"))
    entry = F.struct(F.col(kind).alias("type"), F.col("keywords"))
    return inner.groupBy(owner).agg(F.sort_array(F.collect_list(entry)).alias("extensions"))


def coverage(df: DataFrame, flags: Mapping[str, Column], total: str = "total") -> DataFrame:
    """Total rows and, per flag, the rows for which it holds."""
    return df.agg(F.count(F.lit(1)).alias(total), *[F.count_if(cond).alias(name) for name, cond in flags.items()])


def chain_status(
    df: DataFrame, by: Sequence[str], position: str, ok: Column, message: Column, sep: str = "; "
) -> DataFrame:
    """A function is good only when all overloads are; messages of failed ones joined in order."""
    failed = F.collect_list(F.when(~ok, F.struct(F.col(position).alias("p"), message.alias("m"))))
    return df.groupBy(*by).agg(
        F.bool_and(ok).alias("all_ok"),
        F.count_if(~ok).alias("failed"),
        F.array_join(F.transform(F.array_sort(failed), lambda f: f["m"]), sep).alias("messages"),
    )
