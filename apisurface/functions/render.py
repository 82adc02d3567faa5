"""Signature text built from argument arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from apisurface import schemas as S
from apisurface.functions.text import col_of
from apisurface.functions.types import let

INDENT = "    "


def render_argument(arg: Column) -> Column:
    """One argument: stars, name, annotation and default."""
    stars = F.when(arg["kind"] == S.VAR_POSITIONAL, "*").when(arg["kind"] == S.VAR_KEYWORD, "**").otherwise("")
    return F.concat(
        stars,
        arg["name"],
        F.coalesce(F.concat(F.lit(": "), arg["type"]), F.lit("")),
        F.coalesce(F.concat(F.lit(" = "), arg["default_value"]), F.lit("")),
    )


def render_arguments(args: Column | str) -> Column:
    """Rendered arguments with the ``/`` and ``*`` markers in place."""
    return let(F.struct(col_of(args).alias("args")), lambda given: let(_marker_places(given["args"]), lambda at: _marked_arguments(given["args"], at)))


def _marker_places(args: Column) -> Column:
    """Struct(leading, star): arguments before ``/`` (0: no such) and place, from 1, of the one behind ``*`` (null: no such)."""
    state = F.struct(
        F.size(args).alias("size"),
        F.array_position(F.transform(args["kind"], lambda k: k != S.POSITIONAL_ONLY), True).alias("others"),
        F.array_position(args["kind"], S.KEYWORD_ONLY).alias("keyword"),
        F.array_position(args["kind"], S.VAR_POSITIONAL).alias("variadic"),
    )

    def places(s: Column) -> Column:
        needs_star = (s["keyword"] > 0) & ((s["variadic"] == 0) | (s["variadic"] > s["keyword"]))
        return F.struct(F.when(s["others"] == 0, s["size"]).otherwise(s["others"] - 1).alias("leading"), F.when(needs_star, s["keyword"]).alias("star"))

    return let(state, places)


def _marked_arguments(args: Column, at: Column) -> Column:
    none, slash, star = F.array().cast("array<string>"), F.array(F.lit("/")), F.array(F.lit("*"))

    def with_markers(texts: Column) -> Column:
        # Positional-only arguments come before the ``*``.
        lead, size = at["leading"], F.size(texts)
        upto = F.coalesce(at["star"] - 1, size).cast("int")
        rest = F.concat(
            F.slice(texts, lead + 1, upto - lead), F.when(at["star"].isNotNull(), star).otherwise(none), F.slice(texts, upto + 1, size - upto)
        )
        rest = F.when(at["star"].isNull() & (lead == 0), texts).otherwise(F.when(lead < size, rest).when(lead >= size, none))
        return F.when(lead > 0, F.concat(F.slice(texts, F.lit(1), lead), slash, rest)).otherwise(rest)

    return let(F.transform(args, render_argument), with_markers)


def signature_lines(name: Column | str, args: Column | str, return_type: Column | str) -> Column:
    """Lines of a ``def`` header; more than one argument puts each on its own line."""
    name, return_type = col_of(name), col_of(return_type)
    returns = F.concat(F.coalesce(F.concat(F.lit(" -> "), return_type), F.lit("")), F.lit(":"))
    head = F.concat(F.lit("def "), name, F.lit("("))

    def lines(given: Column) -> Column:
        rendered = render_arguments(given["args"])
        single = F.array(F.concat(head, F.array_join(rendered, ", "), F.lit(")"), returns))
        several = F.concat(
            F.array(head),
            F.transform(rendered, lambda r: F.concat(F.lit(INDENT), r, F.lit(","))),
            F.array(F.concat(F.lit(")"), returns)),
        )
        return F.when(F.size(given["args"]) <= 1, single).otherwise(several)

    # A struct holds the arguments, as they may be null.
    return let(F.struct(col_of(args).alias("args")), lines)


def render_signature(name: Column | str, args: Column | str, return_type: Column | str) -> Column:
    """The lines of ``signature_lines`` as one text, put together without an array of lines."""
    name, return_type = col_of(name), col_of(return_type)
    returns = F.concat(F.lit(")"), F.coalesce(F.concat(F.lit(" -> "), return_type), F.lit("")), F.lit(":"))
    head = F.concat(F.lit("def "), name, F.lit("("))

    def text(given: Column) -> Column:
        rendered = render_arguments(given["args"])
        # A line without text, for want of a name, is left out.
        single = F.coalesce(F.concat(head, F.array_join(rendered, ", "), returns), F.lit(""))
        lines = F.array_join(F.transform(rendered, lambda r: F.concat(F.lit(INDENT), r, F.lit(",\n"))), "")
        several = F.concat(F.coalesce(F.concat(head, F.lit("\n")), F.lit("")), lines, returns)
        return F.when(F.size(given["args"]) <= 1, single).otherwise(several)

    return let(F.struct(col_of(args).alias("args")), text)


def indent(lines: Column | str, depth: Column | int = 1) -> Column:
    """Lines moved right by four spaces per level."""
    pad = F.repeat(F.lit(INDENT), depth if isinstance(depth, Column) else F.lit(depth))
    return F.transform(col_of(lines), lambda line: F.concat(pad, line))


def function_lines(
    name: Column | str,
    args: Column | str,
    return_type: Column | str,
    overloaded: Column | str,
    decorator: Column | str,
    doc: Column | str | None = None,
) -> Column:
    """Lines of one function block: decorator, overload mark, header and body."""
    from apisurface.functions.text import doc_lines

    none = F.array().cast("array<string>")
    decorator = col_of(decorator)
    mark = F.when(decorator.isNotNull(), F.array(F.concat(F.lit("@"), decorator))).otherwise(none)
    overload = F.when(col_of(overloaded), F.array(F.lit("@typing.overload"))).otherwise(none)
    body = F.array(F.lit("..."))
    if doc is not None:
        body = F.when(col_of(doc).isNotNull(), doc_lines(doc)).otherwise(body)
    return F.concat(mark, overload, signature_lines(name, args, return_type), indent(body))


def class_header(name: Column | str, bases: Column | str) -> Column:
    name, bases = col_of(name), col_of(bases)
    listed = F.concat(F.lit("("), F.array_join(bases, ", "), F.lit(")"))
    has_bases = F.coalesce(F.size(bases), F.lit(0)) > 0
    return F.concat(F.lit("class "), name, F.when(has_bases, listed).otherwise(F.lit("")), F.lit(":"))
