"""From call facts to function records: parse calls, returns and checks become signatures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apisurface.functions import rule_packs as R
from apisurface.functions.formats import parse_format_arguments, value_format_type
from apisurface.functions.render import render_signature
from apisurface.functions.signatures import parse_delimited_signature, triplet_arguments
from apisurface.functions.text import cpp_return_type, first_identifier, type_object_name
from apisurface.functions.types import ANY, NEVER, evaluate_once
from apisurface.operators.aggregates import union_types
from apisurface.operators.joins import apply_rules, refine_by_checks, resolve_calls
from apisurface.operators.projections import (
    DELIMITED,
    KEYWORDS,
    METH_O,
    SINGLE_ARGUMENT,
    TRIPLETS,
    TUPLE,
    arguments_read,
    call_convention,
    decode_call_flags,
    receiver_added,
    with_function_id,
)
from apisurface.operators.windows import last_definition
from apisurface.session import cut_lineage, sized


def resolve_slots(slots: DataFrame, checks: DataFrame, rules: DataFrame) -> DataFrame:
    """Argument slots with the type their operand resolves to and the type that checks imply.

    ``slots`` holds fn, call_pos, slot_index, var, operand and default_value. An operand is the text of a type
    object or converter; it is looked up as either.
    """
    plain = rules.drop("imports")
    named = slots.withColumns(
        {"_type_object": type_object_name("operand"), "_converter": first_identifier("operand")}
    )
    named = resolve_calls(named, plain, R.TYPE_OBJECT, "_type_object", out="_as_object")
    named = resolve_calls(named, plain, R.CONVERTER, "_converter", out="_as_converter")
    typed = named.withColumn("type", F.coalesce("_as_object", "_as_converter")).drop(
        "_type_object", "_converter", "_as_object", "_as_converter"
    )
    uses = rules.where(F.col("category") == R.OBJECT_USE).select("name", "type")
    # A variable fills a few slots of its function at most.
    return refine_by_checks(typed, checks, uses, out="refined")


def slot_arrays(slots: DataFrame) -> DataFrame:
    """Slots of one parse call as an ordered array; a call has a handful of them."""
    slot = F.struct(
        F.col("slot_index"), F.col("var").alias("name"), F.col("type"), F.col("refined"), F.col("default_value")
    )
    grouped = slots.groupBy("fn", "call_pos").agg(F.sort_array(F.collect_list(slot)).alias("slots"))
    return grouped.withColumn(
        "slots",
        F.transform(
            "slots",
            lambda s: F.struct(
                s["name"].alias("name"), s["type"].alias("type"), s["refined"].alias("refined"),
                s["default_value"].alias("default_value"),
            ),
        ),
    )


NO_SLOTS = "array<struct<name:string,type:string,refined:string,default_value:string>>"


def parse_facts(parse_calls: DataFrame) -> DataFrame:
    """Parse calls with all columns of the tagged union: ``kind`` says which of ``fmt``, ``names``, ``text`` and ``values`` hold.

    Without ``kind``, calls that list names are keyword calls and others positional.
    """
    given = set(parse_calls.columns)
    types = {"fmt": "string", "names": "array<string>", "text": "string", "values": "array<string>"}
    full = parse_calls.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in given})
    implied = F.when(F.col("names").isNotNull(), F.lit(KEYWORDS)).otherwise(F.lit(TUPLE))
    return full if "kind" in given else full.withColumn("kind", implied)


def parsed_arguments(parse_calls: DataFrame, slots: DataFrame) -> DataFrame:
    """Parse facts per function: ``facts``, an array of struct(kind, args) in the order of calls.

    ``parse_calls`` holds fn, call_pos and, by kind, fmt, names, text or values (``parse_facts``). Each kind is parsed in its own
    branch, so a row is planned for one parser. Calls that do not parse are left out, and so are hidden signature texts.
    """
    facts = parse_facts(parse_calls)
    arrays = slot_arrays(slots)
    made = [TUPLE, KEYWORDS] if "names" in parse_calls.columns or "kind" in parse_calls.columns else [TUPLE]
    made += [DELIMITED] * ("text" in parse_calls.columns) + [TRIPLETS] * ("values" in parse_calls.columns)
    parts = []
    for kind in made:
        rows = facts.where(F.col("kind") == kind)
        if kind == DELIMITED:
            parsed = evaluate_once(rows, "_parsed", parse_delimited_signature("text"))
        else:
            rows = rows.join(arrays, ["fn", "call_pos"], "left").withColumn("slots", F.coalesce("slots", F.array().cast(NO_SLOTS)))
            form = {
                TUPLE: lambda: parse_format_arguments("fmt", "slots"),
                KEYWORDS: lambda: parse_format_arguments("fmt", "slots", "names"),
                TRIPLETS: lambda: triplet_arguments("values", "slots"),
            }[kind]()
            parsed = evaluate_once(rows, "_parsed", form)
        good = parsed.where(F.col("_parsed.error").isNull() & F.col("_parsed.args").isNotNull())
        parts.append(good.select("fn", F.struct("call_pos", F.lit(kind).alias("kind"), F.col("_parsed.args").alias("args")).alias("_fact")))
    good = parts[0]
    for part in parts[1:]:
        good = good.unionByName(part)
    return good.groupBy("fn").agg(
        F.transform(F.sort_array(F.collect_list("_fact")), lambda e: F.struct(e["kind"].alias("kind"), e["args"].alias("args"))).alias("facts")
    )


def value_types(formats: DataFrame, items: DataFrame) -> DataFrame:
    """``fn``, ``expr_id`` and ``type`` of value formats whose arguments are known expressions, innermost first.

    ``formats`` holds fn, expr_id and fmt; ``items`` holds fn, expr_id (that of the format), item_index, type and, where the item
    is a format itself, inner_id. A format is rendered once its inner ones are; rounds follow the depth of nesting. Formats in a
    circle have no type.
    """
    todo = cut_lineage(formats.select("fn", "expr_id", "fmt").distinct())
    items = cut_lineage(items)
    done = None
    while True:
        calls = items.groupBy("fn", "expr_id").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("item_index", "type"))), lambda i: i["type"]).alias("given"),
            F.bool_or(F.col("inner_id").isNotNull()).alias("waits"),
        )
        joined = todo.join(calls, ["fn", "expr_id"])
        ready = evaluate_once(joined.where(~F.col("waits")), "_value", value_format_type("fmt", "given"))
        ready = cut_lineage(ready.select("fn", "expr_id", F.col("_value.type").alias("type")))
        done = ready if done is None else done.unionByName(ready)
        todo = cut_lineage(joined.where("waits").select("fn", "expr_id", "fmt"))
        if ready.isEmpty() or todo.isEmpty():
            return done
        told = ready.select("fn", F.col("expr_id").alias("inner_id"), F.col("type").alias("_type"), F.lit(True).alias("_told"))
        items = items.join(told, ["fn", "inner_id"], "left").select(
            "fn", "expr_id", "item_index", F.coalesce("_type", "type").alias("type"), F.when(F.col("_told").isNull(), F.col("inner_id")).alias("inner_id")
        )
        items = cut_lineage(items)


def infer_return_types(
    returns: DataFrame, assigns: DataFrame, rules: DataFrame, items: DataFrame | None = None, without_none: DataFrame | None = None
) -> DataFrame:
    """Return type and status per function.

    ``returns`` holds fn, pos, expr_kind and expr_name; ``assigns`` holds fn, var, pos, rhs_kind and rhs_name, where a
    negative pos marks the variable's initializer. A ``ref`` is first an object of the rules, else a variable: its last
    definition before the use takes its place, or its initializer if there is none, which is repeated while definitions
    are references themselves. Expressions that cannot be inferred are skipped; the union of the others is the type, and
    a function with returns of which none is inferred gets ``typing.Any`` with status ``failed``.

    ``expr_detail`` and ``rhs_detail``, where there, tell what a computed call's type follows from: the C++ type that
    ``wrap`` wraps, or the type object that an object is created from.

    ``items`` holds the arguments of value formats as expressions of their own: fn, expr_id (that of the format, which ``expr_id`` of
    returns and items and ``rhs_id`` of assignments name), item_index, pos, expr_kind, expr_name and, where there, expr_detail and
    inner_id. An item that cannot be inferred counts as ``typing.Any``. Functions of ``without_none`` (fn) lose returns of ``None``.
    """
    return _return_types(returns, assigns, sized(rules, "rules"), items, without_none)


def _return_types(
    returns: DataFrame, assigns: DataFrame, rules: DataFrame, items: DataFrame | None, without_none: DataFrame | None
) -> DataFrame:
    """``infer_return_types`` with rules of known size."""
    objects = rules.where(F.col("category") == R.OBJECT).select("name", "type")
    calls = rules.where(F.col("category") == R.CALL).select("name", "type")
    no_detail = F.lit(None).cast("string")
    assigns = assigns if "rhs_detail" in assigns.columns else assigns.withColumn("rhs_detail", no_detail)
    returns = returns if "expr_detail" in returns.columns else returns.withColumn("expr_detail", no_detail)
    assigns = assigns if "rhs_id" in assigns.columns else assigns.withColumn("rhs_id", no_detail)
    returns = returns if "expr_id" in returns.columns else returns.withColumn("expr_id", no_detail)
    definitions = assigns.select("fn", "var", "pos", "rhs_kind", "rhs_name", "rhs_detail", "rhs_id")
    ignored, null = F.col("rhs_kind") == "binary", F.col("rhs_kind") == "null"
    done = []
    # The trail holds the variables whose initializers were passed, so that a circle of these ends.
    own = [no_detail.alias("parent"), F.lit(None).cast("int").alias("item_index")]
    fields = ["fn", "pos", "expr_kind", "expr_name", "expr_detail", "expr_id", "parent", "item_index"]
    uses = returns.select(*fields[:6], *own)
    if items is not None:
        for name in ("expr_detail", "inner_id"):
            items = items if name in items.columns else items.withColumn(name, no_detail)
        listed = [F.col("inner_id").alias("expr_id"), F.col("expr_id").alias("parent"), F.col("item_index").cast("int").alias("item_index")]
        uses = uses.unionByName(items.select(*fields[:5], *listed))
    pending = cut_lineage(uses.withColumn("trail", F.array().cast("array<string>")))
    while True:
        is_ref = F.col("expr_kind") == "ref"
        done.append(pending.where(~is_ref).select(*fields))
        # Rules are few, so looking them up again for each of the two branches costs less than storing the references.
        refs = apply_rules(pending.where(is_ref), objects, "expr_name", out="object_type")
        done.append(
            refs.where(F.col("object_type").isNotNull()).select(
                "fn", "pos", F.lit("typed").alias("expr_kind"), F.col("object_type").alias("expr_name"), no_detail.alias("expr_detail"), *fields[5:]
            )
        )
        uses = refs.where(F.col("object_type").isNull()).select("fn", F.col("expr_name").alias("var"), "pos", "trail", "parent", "item_index")
        wanted = definitions.join(uses.select("fn", "var").distinct(), ["fn", "var"], "left_semi")
        resolved = last_definition(
            uses, wanted.withColumn("def_pos", F.col("pos")), ["fn", "var"], ["pos"],
            ["rhs_kind", "rhs_name", "rhs_detail", "rhs_id", "def_pos"], ignored=ignored, is_null=null, initial=F.col("pos") < 0, bucketed=False,
        )
        # The next look-up starts at the definition, so positions fall until only initializers are left.
        usable = F.col("usable") & ~F.array_contains("trail", F.col("var"))
        passed = F.when(F.col("def_pos") < 0, F.array_append("trail", F.col("var"))).otherwise(F.col("trail"))
        pending = cut_lineage(
            resolved.select(
                "fn",
                F.when(usable, F.col("def_pos")).otherwise(F.col("pos")).alias("pos"),
                F.when(usable, F.col("rhs_kind")).otherwise(F.lit("unknown")).alias("expr_kind"),
                F.when(usable, F.col("rhs_name")).alias("expr_name"),
                F.when(usable, F.col("rhs_detail")).alias("expr_detail"),
                F.when(usable, F.col("rhs_id")).alias("expr_id"),
                "parent",
                "item_index",
                passed.alias("trail"),
            )
        )
        if pending.isEmpty():
            break
    expressions = done[0]
    for part in done[1:]:
        expressions = expressions.unionByName(part)
    created = F.when(F.col("expr_name").isin(*R.OBJECT_CREATION), type_object_name("expr_detail"))
    expressions = resolve_calls(
        expressions.withColumn("_created", created), rules.drop("imports"), R.TYPE_OBJECT, "_created", out="_created_type"
    )
    computed = {
        **{name: cpp_return_type("expr_detail") for name in R.COMPUTED_CALLS},
        **{name: F.col("_created_type") for name in R.OBJECT_CREATION},
    }
    typed = apply_rules(expressions, calls, "expr_name", out="call_type", computed=computed)
    kind = F.col("expr_kind")
    inferred = (
        F.when(kind == "call", F.col("call_type"))
        .when(kind == "typed", F.col("expr_name"))
        .when(kind == "value_format", value_format_type("expr_name")["type"])
        .when(kind == "receiver", F.lit("typing.Self"))
        .when(kind == "null", F.lit(NEVER))
    )
    typed = typed.withColumn("type", inferred)
    if items is not None:
        typed = cut_lineage(typed.select("fn", "expr_kind", "expr_name", "expr_id", "parent", "item_index", "type"))
        nested = (kind == "value_format") & F.col("expr_id").isNotNull()
        known = F.when(F.col("type") == NEVER, F.lit(ANY)).otherwise(F.col("type"))
        arguments = typed.where(F.col("parent").isNotNull()).select(
            "fn", F.col("parent").alias("expr_id"), "item_index", F.when(~nested, known).alias("type"), F.when(nested, F.col("expr_id")).alias("inner_id")
        )
        formats = typed.where(nested).select("fn", "expr_id", F.col("expr_name").alias("fmt"))
        values = value_types(formats, arguments).select("fn", "expr_id", F.col("type").alias("_value"))
        typed = typed.where(F.col("parent").isNull()).join(values, ["fn", "expr_id"], "left")
        typed = typed.withColumn("type", F.when(nested, F.col("_value")).otherwise(F.col("type")))
    if without_none is not None:
        marked = without_none.select("fn").distinct().withColumn("_marked", F.lit(True))
        typed = typed.join(marked, "fn", "left")
        typed = typed.withColumn("type", F.when(~(F.coalesce("_marked", F.lit(False)) & F.coalesce(F.col("type") == "None", F.lit(False))), F.col("type")))
    return union_types(typed, ["fn"], "type", out="return_type")


def complete_functions(
    functions: DataFrame,
    parse_calls: DataFrame,
    slots: DataFrame,
    checks: DataFrame,
    returns: DataFrame,
    assigns: DataFrame,
    rules: DataFrame,
    sink: Callable[[DataFrame], None] | None = None,
    items: DataFrame | None = None,
) -> DataFrame:
    """Function records with rendered signatures; ``sink`` may take them instead of the caller.

    ``functions`` holds fn, module_name, class_name, function_name and flags; ``items`` the arguments of value formats. Checks on the
    argument of a single-argument function name it ``arg``. A convention reads the parse facts of its own kinds only. Functions with
    flags for positional and keyword arguments that read a delimited text return no ``None``.
    """
    # Rules of known size are broadcast while they are few, so slots keep the partitions of their functions.
    rules = sized(rules, "rules")
    arguments = parsed_arguments(parse_calls, resolve_slots(slots, checks, rules))
    without_none = None
    if "text" in parse_calls.columns:
        arguments = cut_lineage(arguments)
        reads = arguments.where(F.exists("facts", lambda f: f["kind"] == DELIMITED)).join(functions.select("fn", "flags"), "fn")
        without_none = reads.where(call_convention(F.col("flags")) == "varargs_keywords")
    types = _return_types(returns, assigns, rules, items, without_none)
    facts = functions.join(arguments, "fn", "left").join(types, "fn", "left")
    # The one argument of a single-argument function is refined by the checks on it.
    uses = rules.where(F.col("category") == R.OBJECT_USE).select("name", "type")
    single = functions.where(F.col("flags").bitwiseAND(METH_O) != 0).select("fn", F.lit(SINGLE_ARGUMENT).alias("var"))
    single = refine_by_checks(single, checks, uses, out="single_type").select("fn", "single_type")
    facts = facts.join(single, "fn", "left")
    read = arguments_read(F.col("flags"), F.col("facts"))
    decoded = decode_call_flags(facts, "flags", parsed=read, single_type=F.col("single_type"))
    has_owner = F.col("class_name").isNotNull()
    return_type = F.coalesce("return_type", F.lit("typing.Any"))
    rendered = F.transform(
        "args",
        lambda args, i: F.struct(
            i.cast("int").alias("signature_index"),
            render_signature(F.col("function_name"), receiver_added(args, has_owner, F.col("flags")), return_type).alias("signature"),
            F.lit(None).cast("string").alias("raw_signature"),
        ),
    )
    records = with_function_id(decoded).select(
        "function_id", "module_name", "class_name", "function_name",
        F.lit("c_extension").alias("provider"),
        F.lit("success").alias("mapping_status"),
        "parameter_inference_status",
        F.coalesce("status", F.lit("failed")).alias("return_inference_status"),
        rendered.alias("signatures"),
    )
    if sink is not None:
        sink(records)
    return records
