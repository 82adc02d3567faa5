"""Rule lookup, resolution and reference joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apisurface import schemas as S
from apisurface.functions.types import union_of_texts
from apisurface.session import sized
from apisurface.skew import last_before

def apply_rules(
    df: DataFrame,
    rules: DataFrame,
    on: str,
    default: Column | None = None,
    out: str = "rule_type",
    computed: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Type of each name by exact lookup in rules(name, type[, imports]).

    A miss gives ``default`` or null. ``computed`` gives names whose type is an expression over the
    row instead of a constant.
    """
    columns = [F.col("name").alias(on), F.col("type").alias(out)]
    if "imports" in rules.columns:
        columns.append(F.col("imports").alias(f"{out}_imports"))
    joined = df.join(rules.select(*columns), [on], "left")
    value = F.col(out)
    for name, expression in (computed or {}).items():
        value = F.when(F.col(on) == name, expression).otherwise(value)
    return joined.withColumn(out, value if default is None else F.coalesce(value, default))


def merge_rules(packs: Sequence[DataFrame], keys: Sequence[str] = ("category", "name"), priority: str = "priority") -> DataFrame:
    """Union of rule packs; for each key the row of the highest priority wins."""
    merged = packs[0]
    for pack in packs[1:]:
        merged = merged.unionByName(pack)
    rest = [c for c in merged.columns if c not in keys]
    winner = F.max_by(F.struct(*rest), F.col(priority)).alias("_winner")
    return merged.groupBy(*keys).agg(winner).select(*keys, "_winner.*").select(*merged.columns)


def group_references(refs: DataFrame, keys: Sequence[str], ordinal: str, fields: Sequence[str], out: str = "references") -> DataFrame:
    """Ordered candidates per function; holds the overloads of one function only."""
    candidate = F.struct(F.col(ordinal), *[F.col(f) for f in fields])
    return refs.groupBy(*keys).agg(F.sort_array(F.collect_list(candidate)).alias(out))


def match_references(
    df: DataFrame,
    refs: DataFrame,
    keys: Sequence[str] = ("module_name", "class_path", "function_name"),
    ordinal: str = "ordinal",
    fields: Sequence[str] = ("text", "line"),
    out: str = "references",
) -> DataFrame:
    """Every row with its ordered group of reference signatures, null when there is none."""
    return df.join(group_references(refs, keys, ordinal, fields, out), list(keys), "left")


def missing_references(df: DataFrame, refs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows for which no reference exists."""
    return df.join(refs.select(*keys), list(keys), "left_anti")


def choose_reference(
    df: DataFrame, candidates: Sequence[tuple[str, Column]], missing: str = "missing"
) -> DataFrame:
    """First non-null of an ordered list of (kind, reference); adds ``reference_kind`` and ``reference``."""
    kind = F.coalesce(*[F.when(value.isNotNull(), F.lit(name)) for name, value in candidates], F.lit(missing))
    return df.withColumns(
        {"reference_kind": kind, "reference": F.coalesce(*[value.cast("string") for _, value in candidates])}
    )


def locate_ranges(
    points: DataFrame,
    ranges: DataFrame,
    group: Sequence[str],
    point: str,
    point_id: Sequence[str],
    low: str = "low_pc",
    high: str = "high_pc",
    depth: str | None = None,
    bin_width: int = 4096,
    fan: int = 8,
    error: str = "no range holds the address",
) -> DataFrame:
    """Innermost range ``[low, high)`` of the same group holding each point.

    The smallest range that holds the point owns it; among equal sizes the deepest, then the one of lowest start.
    A range without ``high`` is larger than any with one; of several open ranges the last to start is innermost.

    Ranges are put on the finest grid level on which they span at most ``fan + 1`` bins (level k has
    bins of ``bin_width * fan**k``), so that no range is copied without bound; points look up only the
    levels in use, by an equi join on (group, level, bin) that carries ids and addresses alone. Open ranges
    are an ordered lookup of the last start. Points without an owner stay as rows with ``error`` set.
    """
    group, point_id = list(group), list(point_id)
    span = (F.col("_high") - F.col("_low")).cast("double")
    level = F.greatest(
        F.lit(0), F.ceil(F.log(float(fan), F.greatest(span, F.lit(1.0)) / F.lit(float(bin_width * fan)))).cast("int")
    )

    def bin_of(value: Column) -> Column:
        width = F.lit(float(bin_width)) * F.pow(F.lit(float(fan)), F.col("_level"))
        return F.floor(value / width).cast("bigint")

    rest = [c for c in ranges.columns if c not in (*group, low, high)]
    owner = F.struct(F.col(low), F.col(high), *rest)
    deep = F.lit(0) if depth is None else F.col(depth)
    named = ranges.select(*group, F.col(low).alias("_low"), F.col(high).alias("_high"), deep.alias("_deep"), owner.alias("_owner"))
    slim = points.select(*point_id, *[c for c in group if c not in point_id], F.col(point).alias("_at"))
    binned = (
        named.where(F.col("_high") > F.col("_low"))
        .withColumn("_level", level)
        .withColumn("_bin", F.explode(F.sequence(bin_of(F.col("_low")), bin_of(F.col("_high") - 1))))
    )
    # One row per level in use, at most a few dozen whatever the data size.
    levels = named.where(F.col("_high") > F.col("_low")).select(level.alias("_level"))
    used = levels.agg(F.collect_set("_level")).scalar()
    probes = slim.withColumn("_level", F.explode(used)).withColumn("_bin", bin_of(F.col("_at")))
    held = probes.join(binned, [*group, "_level", "_bin"])
    held = held.where((F.col("_at") >= F.col("_low")) & (F.col("_at") < F.col("_high")))
    # An open range is larger than any other.
    rank = F.struct(F.lit(0).alias("open"), (F.col("_high") - F.col("_low")).alias("size"), (-F.col("_deep")).alias("deep"), F.col("_low").alias("low"))
    claims = held.select(*point_id, "_owner", rank.alias("_claim"))
    # Of open ranges of one start the deepest counts.
    starts = named.where(F.col("_high").isNull() & F.col("_low").isNotNull()).groupBy(*group, "_low")
    starts = starts.agg(F.max_by("_owner", "_deep").alias("_owner")).select(*group, F.col("_low").alias("_at"), "_owner")
    # Points are put in order with open ranges only where their group has such.
    marked = starts.select(F.lit(True).alias("_opens"), *[F.col(g).alias(f"_open_{g}") for g in group]).distinct()
    marked = sized(marked, "open_groups")
    if not marked.isEmpty():
        asked = slim.where(F.col("_at").isNotNull()).select(*group, "_at", F.struct(*point_id).alias("_id"))
        same = F.col("_opens")
        for g in group:
            same = same & F.col(g).eqNullSafe(F.col(f"_open_{g}"))
        asked = asked.join(marked, same, "left_semi")
        both = asked.unionByName(starts, allowMissingColumns=True).withColumn("_kind", F.col("_id").isNotNull().cast("int"))
        last = last_before(both, group, ["_at", "_kind"], F.col("_owner"), "_open")
        opened = last.where(F.col("_id").isNotNull() & F.col("_open").isNotNull()).select("_id.*", "_open")
        least = F.struct(F.lit(1).alias("open"), *[F.lit(0).alias(c) for c in ("size", "deep", "low")])
        least = least.cast(claims.schema["_claim"].dataType).alias("_claim")
        claims = claims.unionByName(opened.select(*point_id, F.col("_open").alias("_owner"), least))
    found = points.join(claims.groupBy(*point_id).agg(F.min_by("_owner", "_claim").alias("_owner")), point_id, "left")
    picked = [F.col("_owner").getField(c).alias(c) for c in (low, high, *rest)]
    return found.select(
        *[F.col(c) for c in points.columns], *picked, F.when(F.col("_owner").isNull(), F.lit(error)).alias("error")
    )


def relative_address(points: DataFrame, libraries: DataFrame, address: str = "address", library: str = "library") -> DataFrame:
    """Add ``binary`` and ``relative_address`` of each address from libraries(library, binary, base)."""
    table = libraries.select(F.col("library").alias(library), "binary", "base")
    joined = points.join(table, [library], "left")
    return joined.withColumn("relative_address", (F.col(address) - F.col("base")).cast("bigint")).drop("base")


def join_by_identity(
    df: DataFrame,
    by_linkage: DataFrame,
    by_name: DataFrame,
    linkage: str = "linkage_name",
    name: str = "function_name",
    scope: Sequence[str] = (),
) -> DataFrame:
    """Definition by linkage name where one is known, otherwise by function name.

    A linkage name that finds nothing does not fall back. Both tables have unique keys; the two
    halves are joined apart and recombined.
    """
    scope = list(scope)
    linked = df.where(F.col(linkage).isNotNull()).join(by_linkage, [*scope, linkage], "left")
    named = df.where(F.col(linkage).isNull()).join(by_name, [*scope, name], "left")
    return linked.unionByName(named, allowMissingColumns=True)


# Fixed value: text of the argument list that stands in for an unknown signature.
MINIMAL_SIGNATURE = "(*args, **kwargs)"


def minimal_args(type_text: str | None = "object") -> Column:
    def argument(name: str, kind: str) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            F.lit(type_text).cast("string").alias("type"),
            F.lit(None).cast("string").alias("default_value"),
            F.lit(kind).alias("kind"),
        )

    return F.array(argument("args", S.VAR_POSITIONAL), argument("kwargs", S.VAR_KEYWORD))


def complete_with_fallback(
    df: DataFrame,
    c_outcome: str = "c_outcome",
    pybind_outcome: str = "pybind_outcome",
    c_reason: str = "c_reason",
    pybind_reason: str = "pybind_reason",
) -> DataFrame:
    """Outcome of the provider chain: C extension, then pybind11, then unsupported.

    An outcome is null (not matched), ``ok``, ``unsupported``, ``partial`` (source found, inference
    failed) or ``error``. Only ``unsupported`` hands over to the next provider. Adds ``provider``,
    ``outcome`` (completed, failed or unsupported), ``mapping_status``, ``use_minimal`` and ``failure_reason``.
    """
    c, p = F.col(c_outcome), F.col(pybind_outcome)
    c_decides = F.coalesce(c.isin("ok", "partial", "error"), F.lit(False))
    p_decides = ~c_decides & F.coalesce(p.isin("ok", "partial", "error"), F.lit(False))
    decided = F.when(c_decides, c).when(p_decides, p)
    reason = F.when(c_decides, F.col(c_reason)).when(p_decides, F.col(pybind_reason)).otherwise(
        F.coalesce(
            F.when(p == "unsupported", F.col(pybind_reason)),
            F.when(c == "unsupported", F.col(c_reason)),
            F.lit("no provider handles this function"),
        )
    )
    failed = F.coalesce(decided.isin("partial", "error"), F.lit(False))
    return df.withColumns(
        {
            "provider": F.when(c_decides, F.lit("c_extension")).when(p_decides, F.lit("pybind11")),
            "outcome": F.when(decided.isNull(), F.lit("unsupported")).when(failed, F.lit("failed")).otherwise(
                F.lit("completed")
            ),
            "mapping_status": F.when(decided.isin("ok", "partial"), F.lit("success")).when(
                decided == "error", F.lit("failed")
            ),
            "use_minimal": failed,
            "failure_reason": F.when(failed | decided.isNull(), reason),
        }
    )


def refine_by_checks(
    args: DataFrame,
    checks: DataFrame,
    rules: DataFrame,
    keys: Sequence[str] = ("fn", "var"),
    call: str = "call_name",
    out: str = "refined_type",
    default: str = "object",
) -> DataFrame:
    """Union of the types implied by check calls on the same variable, else ``object``.

    Checks are first reduced to distinct (key, type), so the hot part shrinks before it is shuffled.
    """
    keys = list(keys)
    typed = apply_rules(checks.select(*keys, call), rules, call, out="_type").where(F.col("_type").isNotNull())
    unions = (
        typed.select(*keys, "_type").distinct().groupBy(*keys)
        .agg(union_of_texts(F.collect_set("_type")).alias(out))
    )
    joined = args.join(unions, keys, "left")
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(default)))


def keyword_hits(texts: DataFrame, keywords: Mapping[str, str], text: str) -> DataFrame:
    """One row per text and keyword contained in it, with the keyword's type.

    The keyword list is a configuration value, so the tests are one projection over the scan.
    """
    checks = F.array(
        *[
            F.when(
                F.contains(F.col(text), F.lit(word)),
                F.struct(F.lit(word).alias("keyword"), F.lit(kind).alias("type")),
            )
            for word, kind in keywords.items()
        ]
    )
    rest = [c for c in texts.columns if c != text]
    return texts.select(*rest, F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("_hit")).select(
        *rest, "_hit.keyword", "_hit.type"
    )


def match_keywords(texts: DataFrame, keywords: Mapping[str, str], owner: str, text: str) -> DataFrame:
    """Distinct (owner, keyword, type) over all texts of an owner."""
    return keyword_hits(texts.select(owner, text), keywords, text).distinct()


def resolve_calls(calls: DataFrame, rules: DataFrame, category: str, on: str, default: Column | None = None, **kwargs) -> DataFrame:
    """``apply_rules`` with the rules of one category."""
    return apply_rules(calls, rules.where(F.col("category") == category).drop("category"), on, default, **kwargs)

