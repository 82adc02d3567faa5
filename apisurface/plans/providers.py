"""The provider chain: members of modules to function records by C source, by overload texts, or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apisurface.functions.render import render_signature
from apisurface.functions.signatures import parse_overload
from apisurface.functions.types import evaluate_once
from apisurface.operators.aggregates import chain_status
from apisurface.operators.filters import drop_internal, own_members
from apisurface.operators.joins import complete_with_fallback, join_by_identity, locate_ranges
from apisurface.operators.projections import classify_callable, with_function_id

HANDLE_FLAGS = ["builtin", "bound_to_pybind", "method_descriptor", "class_method_descriptor", "instance_method", "static_wrapper"]
#: What a function that failed is shown as.
MINIMAL = "(*args: object, **kwargs: object) -> typing.Any"
SIGNATURE = "array<struct<signature_index:int,signature:string,raw_signature:string>>"


def classified_members(members: DataFrame) -> DataFrame:
    """Own, not internal members with provider, kind and decorator.

    ``members`` holds fn, module_name, class_name, function_name, defined_in, is_callable and the handle flags.
    """
    kept = own_members(drop_internal(members, "function_name"), "function_name", F.col("is_callable"), "defined_in", "module_name")
    return classify_callable(kept, F.col("class_name").isNotNull(), *[F.col(flag) for flag in HANDLE_FLAGS])


def mapped_functions(members: DataFrame, ranges: DataFrame, by_linkage: DataFrame, by_name: DataFrame) -> DataFrame:
    """``fn``, ``definition``, ``range_error``: the definition that holds the address of a C function.

    ``members`` holds fn, binary and address; ``ranges`` holds binary, low_pc, high_pc, depth, linkage_name and
    function_name; the definition tables hold binary, the name and ``definition``.
    """
    points = members.select("fn", "binary", "address")
    located = locate_ranges(points, ranges, ["binary"], "address", ["fn"], depth="depth")
    owned = located.select("fn", "binary", "linkage_name", "function_name", F.col("error").alias("range_error"))
    return join_by_identity(owned, by_linkage, by_name, scope=["binary"]).select("fn", "definition", "range_error")


def overload_signatures(functions: DataFrame, overloads: DataFrame) -> DataFrame:
    """``fn``, ``all_ok``, ``messages``, ``pybind_signatures``: a function is good only if all its overload texts parse.

    ``overloads`` holds fn, position and text.
    """
    named = overloads.join(functions.select("fn", "function_name"), "fn")
    parsed = evaluate_once(named, "_p", parse_overload("text"))
    good = F.col("_p.error").isNull()
    shown = render_signature(F.col("function_name"), F.col("_p.args"), F.col("_p.return_type"))
    rows = parsed.select("fn", "position", good.alias("_ok"), F.col("_p.error").alias("_error"), shown.alias("_shown"), "text")
    status = chain_status(rows, ["fn"], "position", F.col("_ok"), F.coalesce("_error", F.lit("")))
    entry = F.struct("position", F.col("_shown").alias("signature"), F.col("text").alias("raw_signature"))
    listed = rows.groupBy("fn").agg(F.sort_array(F.collect_list(entry)).alias("_entries"))
    signatures = F.transform(
        "_entries",
        lambda e, i: F.struct(i.cast("int").alias("signature_index"), e["signature"].alias("signature"), e["raw_signature"].alias("raw_signature")),
    )
    return status.join(listed, "fn").select("fn", "all_ok", "messages", signatures.cast(SIGNATURE).alias("pybind_signatures"))


def complete_chain(
    members: DataFrame, completed: DataFrame, overloads: DataFrame, ranges: DataFrame, by_linkage: DataFrame, by_name: DataFrame
) -> DataFrame:
    """Function records of all members that a provider handles; unsupported ones have no row.

    ``completed`` is what ``complete_functions`` makes of the facts of each definition, with its ``definition`` id. A C
    function outside of every range is left to the next provider; one whose definition is not known has failed; one whose parameters
    are not inferred is mapped but shown with the minimal signature. Overload texts count all or none.
    """
    functions = classified_members(members)
    c_functions = functions.where(F.col("provider") == "c_extension")
    mapped = mapped_functions(c_functions, ranges, by_linkage, by_name).withColumn("is_c", F.lit(True))
    facts = completed.select(
        "definition", F.col("signatures").alias("c_signatures"), F.col("parameter_inference_status").alias("c_parameter"),
        F.col("return_inference_status").alias("c_return"),
    )
    texts = overload_signatures(functions.where(F.col("provider") == "pybind11"), overloads)
    joined = functions.drop("provider").join(mapped, "fn", "left").join(facts, "definition", "left").join(texts, "fn", "left")
    parameters = F.col("c_parameter") == "success"
    joined = joined.withColumns(
        {
            "c_outcome": F.when(F.col("is_c").isNull(), F.lit(None))
            .when(F.col("range_error").isNotNull(), F.lit("unsupported"))
            .when(F.col("c_parameter").isNull(), F.lit("error"))
            .when(parameters, F.lit("ok"))
            .otherwise(F.lit("partial")),
            "c_reason": F.when(F.col("range_error").isNotNull(), F.col("range_error"))
            .when(F.col("c_parameter").isNull(), F.lit("definition not found"))
            .otherwise(F.lit("parameters were not inferred")),
            "pybind_outcome": F.when(F.col("all_ok"), F.lit("ok")).when(~F.col("all_ok"), F.lit("error")),
            "pybind_reason": F.col("messages"),
        }
    )
    done = complete_with_fallback(joined).where(F.col("outcome") != "unsupported")
    minimal = F.array(
        F.struct(
            F.lit(0).alias("signature_index"),
            F.concat(F.lit("def "), F.col("function_name"), F.lit(MINIMAL), F.lit(":")).alias("signature"),
            F.lit(None).cast("string").alias("raw_signature"),
        )
    )
    by_c = F.col("provider") == "c_extension"
    failed = F.lit("failed")
    return with_function_id(done).select(
        "function_id", "module_name", "class_name", "function_name", "decorator", "provider", "mapping_status",
        F.when(F.col("use_minimal"), failed).when(by_c, F.col("c_parameter")).otherwise(F.lit("success")).alias("parameter_inference_status"),
        F.when(by_c, F.coalesce("c_return", failed)).when(F.col("use_minimal"), failed).otherwise(F.lit("success")).alias("return_inference_status"),
        "failure_reason",
        F.when(F.col("use_minimal"), minimal).when(by_c, F.col("c_signatures")).otherwise(F.col("pybind_signatures")).alias("signatures"),
    )
