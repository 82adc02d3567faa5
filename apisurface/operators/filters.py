"""Filters, domain checks and routing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apisurface.functions import text as X
from apisurface.functions.signatures import HIDDEN_SUFFIXES, signature_suffix

# Members that tools generate and users never call.
INTERNAL_NAMES = ["__reduce_cython__", "__setstate_cython__", "_pybind11_conduit_v1_"]
INTERNAL_PREFIXES = ["__pythran_wrapall"]


def own_members(df: DataFrame, name: str, is_callable: Column, defined_in: str, module: str) -> DataFrame:
    """Members defined in their own module; what is not callable stays, ``annotations`` goes."""
    foreign = is_callable & ~F.col(defined_in).eqNullSafe(F.col(module))
    return df.where((F.col(name) != "annotations") & ~foreign)


def drop_internal(
    df: DataFrame,
    name: str,
    names: Sequence[str] = INTERNAL_NAMES,
    prefixes: Sequence[str] = INTERNAL_PREFIXES,
    binary: str | None = None,
    host_binary: str | None = None,
) -> DataFrame:
    """Rows whose name is not listed, has no listed prefix and does not live in the host binary."""
    keep = F.lit(True)
    if names:
        keep = keep & ~F.col(name).isin(*names)
    for prefix in prefixes:
        keep = keep & ~F.startswith(F.col(name), F.lit(prefix))
    if binary is not None:
        keep = keep & ~F.col(binary).eqNullSafe(F.lit(host_binary))
    return df.where(keep | F.col(name).isNull()) if binary is None else df.where(keep)


def drop_listed(df: DataFrame, denied: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in a deny table of any size."""
    return df.join(denied.select(*on), list(on), "left_anti")


def blank_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: X.blank_to_null(c) for c in cols})


def violations(rules: Mapping[str, Sequence[str]]) -> Column:
    """Text naming the first column whose value lies outside its domain, null when all are inside."""
    found = [
        F.when(
            ~F.coalesce(F.col(name).isin(*domain), F.lit(False)),
            F.concat(F.lit(f"illegal {name}: "), F.coalesce(F.col(name).cast("string"), F.lit("null"))),
        )
        for name, domain in rules.items()
    ]
    return F.coalesce(*found)


def check_domain(
    df: DataFrame, rules: Mapping[str, Sequence[str]], ids: Sequence[str] = (), mode: str = "strict"
) -> DataFrame:
    """Check columns against their domains.

    ``mode="mark"`` adds a ``violation`` column; ``mode="strict"`` makes the query fail at the
    first illegal row and names the row by ``ids``.
    """
    problem = violations(rules)
    if mode == "mark":
        return df.withColumn("violation", problem)
    if mode != "strict":
        raise ValueError(f"unknown mode {mode!r}")
    where = F.concat_ws(", ", *[F.concat(F.lit(f"{i}="), F.coalesce(F.col(i).cast("string"), F.lit(""))) for i in ids])
    message = F.concat(problem, F.lit(" at "), where) if ids else problem
    return df.where(F.when(problem.isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def split_double_failures(
    df: DataFrame,
    parameter_status: str = "parameter_inference_status",
    return_status: str = "return_inference_status",
) -> tuple[DataFrame, DataFrame]:
    """(rows with both inferences failed, all other rows); together they are the whole input."""
    failed = (~F.coalesce(F.col(parameter_status) == "success", F.lit(False))) & (
        ~F.coalesce(F.col(return_status) == "success", F.lit(False))
    )
    return df.where(failed), df.where(~failed)


def drop_hidden(df: DataFrame, signature: str, strict: bool = True) -> DataFrame:
    """Signatures without a hiding suffix; any other suffix is an error in strict mode."""
    suffix = signature_suffix(signature)
    visible = suffix.isNull()
    if strict:
        message = F.concat(F.lit("unknown signature suffix: "), suffix)
        visible = F.when(suffix.isNull(), True).when(suffix.isin(*HIDDEN_SUFFIXES), False).otherwise(
            F.raise_error(message).cast("boolean")
        )
    return df.where(visible)


def bases_until(df: DataFrame, bases: str, marker: str, skip: str = "object", out: str | None = None) -> DataFrame:
    """Base classes up to the first one of the marker module, without ``skip``."""
    values = F.col(bases)
    at = F.array_position(F.transform(values, lambda b: (b == marker) | F.startswith(b, F.lit(marker + "."))), True)
    kept = F.when(at > 0, F.slice(values, F.lit(1), (at - 1).cast("int"))).otherwise(values)
    return df.withColumn(out or bases, F.array_remove(kept, skip))
