"""Row-wise operators over catalogs and call facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apisurface import schemas as S
from apisurface.functions import text as X
from apisurface.session import cut_lineage

# Call flags of a C function.
METH_VARARGS = 1
METH_KEYWORDS = 2
METH_NOARGS = 4
METH_O = 8
METH_CLASS = 16
METH_STATIC = 32
METH_FASTCALL = 128

# Reasons recorded where an inference step failed.
FAILED_REASONS = {
    "parameter_structure": "参数推断阶段失败，参数结构计为不合格。",
    "parameter_type": "参数推断阶段失败，参数类型计为不合格。",
    "return_type": "返回值推断阶段失败，返回类型计为不合格。",
}
FAILED_CODE = "rule_unqualified"


def with_name_parts(df: DataFrame, col: str, sep: str = ".", prefix: str = "name") -> DataFrame:
    """Add ``{prefix}_parts``, ``{prefix}_parent`` and ``{prefix}_leaf``."""
    parts = X.name_parts(col, sep)
    return df.withColumns({f"{prefix}_{field}": parts[field] for field in ("parts", "parent", "leaf")})


def with_function_id(
    df: DataFrame,
    module: str = "module_name",
    class_name: str = "class_name",
    function: str = "function_name",
    out: str = "function_id",
) -> DataFrame:
    return df.withColumn(out, X.function_id(module, class_name, function))


def explode_signatures(df: DataFrame, col: str = "signatures", index: str = "signature_index") -> DataFrame:
    """One row per signature with its 0-based index and the function's signature count."""
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.size(col).alias("signature_count"), F.posexplode(col).alias(index, "signature"))


def collect_signatures(
    df: DataFrame, keys: Sequence[str], idx: str, fields: Sequence[str], out: str = "signatures"
) -> DataFrame:
    """Regroup the signatures of a function in index order.

    The array holds the overloads of one function, so its length does not grow with the catalog.
    """
    element = F.struct(F.col(idx), *[F.col(f) for f in fields])
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(element)).alias(out))


def with_evidence(df: DataFrame, cols: Sequence[str], out: str = "evidence", blank: bool = True) -> DataFrame:
    """JSON of the non-blank fields, null when all are blank."""
    fields = [X.blank_to_null(c).alias(c) if blank else F.col(c) for c in cols]
    present = F.coalesce(*[f.cast("string") for f in fields]).isNotNull()
    return df.withColumn(out, F.when(present, F.to_json(F.struct(*fields))))


def flatten_tree(
    nodes: DataFrame,
    node_id: str = "node_id",
    parent_id: str = "parent_id",
    name: str = "name",
    kind: str | None = None,
    kind_order: Sequence[str] = ("function", "class", "module"),
    sep: str = ".",
    orphans: bool = False,
) -> DataFrame:
    """Nodes with dotted path, depth and the key that puts a module's text in order.

    ``sort_path`` sorts kinds in ``kind_order`` (direct functions before classes) and names within
    each level. Paths are doubled: each round puts the path of the node a path begins below in front of it, so rounds grow with the
    logarithm of the depth. Ids are unique; a node that does not hang below a root (its parent is missing,
    or it lies on a cycle) has no path: with ``orphans`` it comes out with nulls, else it is left out.
    """
    rank = F.lit(0) if kind is None else F.array_position(F.lit(list(kind_order)), F.col(kind)).cast("int")
    rows = nodes.select(
        F.col(node_id).alias("_id"),
        F.col(parent_id).alias("_parent"),
        F.col(name).cast("string").alias("_name"),
        rank.alias("_rank"),
    )
    rows = cut_lineage(rows)
    rooted = rows.join(_rooted(rows.select("_id", F.col("_parent").alias("_up"))), "_id", "left_semi")
    # Names alone are carried along (and ranks, if kinds have some); paths are put together at the end.
    carried = {"names": F.array("_name"), **({} if kind is None else {"ranks": F.array("_rank")})}
    paths = cut_lineage(rooted.select("_id", F.col("_parent").alias("_up"), *[v.alias(c) for c, v in carried.items()]))
    done = None
    while True:
        whole = paths.where(F.col("_up").isNull())
        done = whole if done is None else done.unionByName(whole)
        open_ = paths.where(F.col("_up").isNotNull())
        if open_.isEmpty():
            break
        # What ended in earlier rounds is still wanted as a beginning.
        above = done.unionByName(open_).select(F.col("_id").alias("_up"), F.col("_up").alias("_next"), *[F.col(c).alias(f"_{c}_head") for c in carried])
        paths = cut_lineage(open_.join(above, "_up").select("_id", F.col("_next").alias("_up"), *[F.concat(f"_{c}_head", c).alias(c) for c in carried]))
    path = F.when(F.size("names") > 1, F.array_join("names", sep)).otherwise(F.get("names", F.lit(0)))
    step = (lambda n, i: F.struct(F.lit(0).alias("rank"), n.alias("name"))) if kind is None else (lambda n, i: F.struct(F.get("ranks", i).alias("rank"), n.alias("name")))
    result = done.select("_id", path.alias("path"), F.transform("names", step).alias("sort_path"), (F.size("names") - 1).alias("depth"))
    if orphans:
        result = rows.select("_id").join(result, "_id", "left")
    return result.withColumnRenamed("_id", node_id)


def _rooted(pointers: DataFrame) -> DataFrame:
    """Ids (``_id``) from which the pointers ``_up`` lead to an end, by doubling; those on and below a cycle never get there."""
    most, ended = pointers.count().bit_length() + 1, None
    for _ in range(most):
        there = pointers.where(F.col("_up").isNull()).select("_id")
        ended = there if ended is None else ended.unionByName(there)
        going = pointers.where(F.col("_up").isNotNull())
        if going.isEmpty():
            break
        ahead = ended.select(F.col("_id").alias("_up"), F.lit(None).cast(dict(going.dtypes)["_up"]).alias("_next"))
        ahead = ahead.unionByName(going.select(F.col("_id").alias("_up"), F.col("_up").alias("_next")))
        pointers = cut_lineage(going.join(ahead, "_up").select("_id", F.col("_next").alias("_up")))
    return ended


def classify_callable(
    df: DataFrame,
    has_owner: Column,
    builtin: Column,
    bound_to_pybind: Column,
    method_descriptor: Column,
    class_method_descriptor: Column,
    instance_method: Column,
    static_wrapper: Column,
) -> DataFrame:
    """Add ``provider``, ``callable_kind`` and ``decorator`` from what is known about a handle.

    ``builtin`` and ``bound_to_pybind`` describe the wrapped function for wrappers; a pybind
    class has no class methods.
    """
    plain = builtin & ~static_wrapper & ~instance_method
    c_function, p_function = builtin & ~bound_to_pybind, builtin & bound_to_pybind
    kind = (
        F.when(~has_owner & plain, F.lit("module_function"))
        .when(has_owner & method_descriptor, F.lit("instance_method"))
        .when(has_owner & class_method_descriptor, F.lit("class_method"))
        .when(has_owner & static_wrapper & builtin, F.lit("static_method"))
        .when(has_owner & instance_method & p_function, F.lit("instance_method"))
    )
    provider = F.when(
        kind.isNotNull(),
        F.when(method_descriptor | class_method_descriptor | c_function, F.lit("c_extension")).otherwise(
            F.lit("pybind11")
        ),
    )
    decorator = F.when(kind == "class_method", F.lit("classmethod")).when(
        kind == "static_method", F.lit("staticmethod")
    )
    return df.withColumns({"callable_kind": kind, "provider": provider, "decorator": decorator})


def _arg(name: str, kind: str, type_text: str | None = "object") -> Column:
    return F.struct(
        F.lit(name).alias("name"),
        F.lit(type_text).cast("string").alias("type"),
        F.lit(None).cast("string").alias("default_value"),
        F.lit(kind).alias("kind"),
    )


#: Name of the argument of a single-argument function.
SINGLE_ARGUMENT = "arg"


#: Kinds of parse facts: positional and keyword formats, delimited signature texts, and name, converter, slot triplets.
TUPLE, KEYWORDS, DELIMITED, TRIPLETS = "tuple", "keywords", "delimited", "triplets"

# What each variadic convention reads, in this order.
READ_BY = {"fastcall": [TRIPLETS], "varargs_keywords": [TUPLE, KEYWORDS, DELIMITED], "varargs": [TUPLE, DELIMITED]}


def call_convention(flags: Column) -> Column:
    """Name of the calling convention that flags stand for; the first that fits counts."""

    def has(bit: int) -> Column:
        return flags.bitwiseAND(bit) != 0

    return (
        F.when(has(METH_NOARGS), F.lit("noargs"))
        .when(has(METH_O), F.lit("single"))
        .when(has(METH_FASTCALL), F.lit("fastcall"))
        .when(has(METH_VARARGS) & has(METH_KEYWORDS), F.lit("varargs_keywords"))
        .when(has(METH_VARARGS), F.lit("varargs"))
        .otherwise(F.lit("unknown"))
    )


def arguments_read(flags: Column, facts: Column) -> Column:
    """Argument arrays among parse facts (array of struct(kind, args)) that the convention reads, kind after kind; null for the others."""

    def of(kind: str) -> Column:
        return F.transform(F.filter(facts, lambda f: f["kind"] == kind), lambda f: f["args"])

    chosen = F.lit(None).cast(f"array<array<{S.ARGUMENT}>>")
    convention = call_convention(flags)
    for name, kinds in READ_BY.items():
        chosen = F.when(convention == name, F.concat(*[of(k) for k in kinds])).otherwise(chosen)
    return chosen


def decode_call_flags(df: DataFrame, flags: str, parsed: Column | None = None, single_type: Column | None = None) -> DataFrame:
    """Add ``args`` (array of argument arrays), ``convention`` and ``parameter_inference_status``.

    ``parsed`` holds the argument arrays found in parse calls; without any, a variadic
    convention keeps the skeleton ``*args[, **kwargs]`` and counts as failed. ``single_type`` is what is known of
    the argument of a single-argument function, ``object`` where it is null.
    """

    def has(bit: int) -> Column:
        return F.col(flags).bitwiseAND(bit) != 0

    none = F.array().cast(f"array<{S.ARGUMENT}>")
    single = _arg(SINGLE_ARGUMENT, S.POSITIONAL_ONLY)
    if single_type is not None:
        single = single.withField("type", F.coalesce(single_type, F.lit("object")))
    minimal = F.when(
        has(METH_KEYWORDS),
        F.array(_arg("args", S.VAR_POSITIONAL), _arg("kwargs", S.VAR_KEYWORD)),
    ).otherwise(F.array(_arg("args", S.VAR_POSITIONAL)))
    convention = call_convention(F.col(flags))
    found = F.lit(None).cast(f"array<array<{S.ARGUMENT}>>") if parsed is None else parsed
    usable = F.coalesce(F.size(found) > 0, F.lit(False))
    args = (
        F.when(convention == "noargs", F.array(none))
        .when(convention == "single", F.array(F.array(single)))
        .when(convention == "unknown", F.array(none))
        .when(usable, found)
        .otherwise(F.array(minimal))
    )
    good = convention.isin("noargs", "single") | ((convention != "unknown") & usable)
    return df.withColumns(
        {
            "convention": convention,
            "args": args,
            "parameter_inference_status": F.when(good, F.lit("success")).otherwise(F.lit("failed")),
        }
    )


def receiver_added(args: Column, has_owner: Column, flags: Column) -> Column:
    """Argument array with ``self`` or ``cls`` in front unless static or module-level."""
    first_kind = F.try_element_at(args, F.lit(1))["kind"]
    receiver = F.struct(
        F.when(flags.bitwiseAND(METH_CLASS) != 0, F.lit("cls")).otherwise(F.lit("self")).alias("name"),
        F.lit(None).cast("string").alias("type"),
        F.lit(None).cast("string").alias("default_value"),
        F.when(first_kind == S.POSITIONAL_ONLY, F.lit(S.POSITIONAL_ONLY))
        .otherwise(F.lit(S.POSITIONAL_OR_KEYWORD))
        .alias("kind"),
    )
    return F.when(has_owner & (flags.bitwiseAND(METH_STATIC) == 0), F.concat(F.array(receiver), args)).otherwise(args)


def add_receiver(df: DataFrame, args: str, has_owner: Column, flags: str) -> DataFrame:
    return df.withColumn(args, receiver_added(F.col(args), has_owner, F.col(flags)))


def override_failed(
    df: DataFrame,
    parameter_status: str = "parameter_inference_status",
    return_status: str = "return_inference_status",
    dimensions: Mapping[str, str] | None = None,
) -> DataFrame:
    """Replace code and reason of every dimension whose inference step did not succeed.

    ``dimensions`` maps a dimension to the status column that governs it.
    """
    governed = dimensions or {
        "parameter_structure": parameter_status,
        "parameter_type": parameter_status,
        "return_type": return_status,
    }
    changes = {}
    for dimension, status in governed.items():
        failed = ~F.coalesce(F.col(status) == "success", F.lit(False))
        code, reason = f"{dimension}_code", f"{dimension}_reason"
        changes[code] = F.when(failed, F.lit(FAILED_CODE)).otherwise(F.col(code))
        if reason in df.columns:
            changes[reason] = F.when(failed, F.lit(FAILED_REASONS[dimension])).otherwise(F.col(reason))
    return df.withColumns(changes)
