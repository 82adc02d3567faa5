"""Argument and value format strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from apisurface import schemas as S
from apisurface.functions.text import col_of
from apisurface.functions.types import ANY, canonical_members, let, union_members

_STR_BUFFER = "str | collections.abc.Buffer"
_TEXT_LIKE = "str | bytes | bytearray"

# Argument format units as unit -> (C slots, slot that receives the value, type).
ARGUMENT_UNITS = {
    "es#": (3, 1, "str"),
    "et#": (3, 1, _TEXT_LIKE),
    "s*": (1, 0, _STR_BUFFER),
    "s#": (2, 0, _STR_BUFFER),
    "z*": (1, 0, _STR_BUFFER + " | None"),
    "z#": (2, 0, _STR_BUFFER + " | None"),
    "y*": (1, 0, "collections.abc.Buffer"),
    "y#": (2, 0, "collections.abc.Buffer"),
    "es": (2, 1, "str"),
    "et": (2, 1, _TEXT_LIKE),
    "w*": (1, 0, "collections.abc.Buffer"),
    "O!": (2, 1, "object"),
    "O&": (2, 1, "object"),
    "s": (1, 0, "str"),
    "z": (1, 0, "str | None"),
    "y": (1, 0, "collections.abc.Buffer"),
    "S": (1, 0, "bytes"),
    "Y": (1, 0, "bytearray"),
    "U": (1, 0, "str"),
    **{unit: (1, 0, "int") for unit in "bBhHiIlkLKn"},
    "c": (1, 0, "bytes | bytearray"),
    "C": (1, 0, "str"),
    "f": (1, 0, "float"),
    "d": (1, 0, "float"),
    "D": (1, 0, "complex"),
    "O": (1, 0, "object"),
    "p": (1, 0, "bool"),
}

# Value format units as unit -> (arguments, member types).
VALUE_UNITS = {
    **{unit: (2, ["None", "str"]) for unit in ("s#", "z#", "u#", "U#")},
    "y#": (2, ["None", "bytes"]),
    "O&": (2, [ANY]),
    **{unit: (1, ["None", "str"]) for unit in "szuU"},
    "y": (1, ["None", "bytes"]),
    **{unit: (1, ["int"]) for unit in "ibhlBHIkLKn"},
    "c": (1, ["bytes"]),
    "C": (1, ["str"]),
    "d": (1, ["float"]),
    "f": (1, ["float"]),
    "D": (1, ["complex"]),
    **{unit: (1, [ANY]) for unit in "OSN"},
}


def _alternatives(units: dict) -> str:
    """Regular expression matching the longest unit first."""
    longest_first = sorted(units, key=len, reverse=True)
    return "|".join("\\Q" + unit + "\\E" for unit in longest_first)


ARGUMENT_PATTERN = _alternatives(ARGUMENT_UNITS) + "|[|$()]"
VALUE_PATTERN = _alternatives(VALUE_UNITS) + "|[()\\[\\]{}]"


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "\\'") + "'"


# What a positional format of units alone has that needs a closer look: tuples, a second ``|``.
NOT_FLAT = "(?s)[()$]|\\|.*\\|"
# What a keyword format has in order: units, then those behind one ``|``, then those behind one ``$``.
KEYWORD_FORM = "\\A[^()|$]*+(?:\\|[^()|$]*+(?:\\$[^()|$]*+)?)?\\z"


def _argument_unit_map() -> Column:
    """Unit table as one literal map, folded to a constant by the optimizer."""
    entries = [
        f"{_quoted(unit)}, named_struct('slots', {slots}, 'receiver', {receiver}, 'type', {_quoted(type_text)}, "
        f"'resolved', {str(unit in ('O!', 'O&')).lower()})"
        for unit, (slots, receiver, type_text) in ARGUMENT_UNITS.items()
    ]
    return F.expr(f"map({', '.join(entries)})")


def _value_unit_map() -> Column:
    entries = [
        f"{_quoted(unit)}, named_struct('slots', {slots}, 'members', array({', '.join(map(_quoted, members))}), "
        f"'resolved', {str(members == [ANY]).lower()})"
        for unit, (slots, members) in VALUE_UNITS.items()
    ]
    return F.expr(f"map({', '.join(entries)})")


def _with_units(tokens: Column, units: Column) -> Column:
    """Array of struct(token, unit) so that each token is looked up once."""
    return F.transform(tokens, lambda t: F.struct(t.alias("token"), F.try_element_at(units, t).alias("unit")))


def format_body(fmt: Column | str) -> Column:
    """Format without the function name or message after ``:`` or ``;``."""
    return F.element_at(F.split(col_of(fmt), "[:;]"), 1)


def format_tokens(fmt: Column | str) -> Column:
    """Tokens of an argument format, longest unit first; characters of no unit are left out."""
    return F.regexp_extract_all(format_body(fmt), F.lit("(" + ARGUMENT_PATTERN + ")"), F.lit(1))


def tokenize_format(fmt: Column | str) -> Column:
    """Array of struct(unit, slots, type); markers have no slots and no type."""
    return F.transform(
        _with_units(format_tokens(fmt), _argument_unit_map()),
        lambda item: F.struct(
            item["token"].alias("unit"),
            F.coalesce(item["unit"]["slots"], F.lit(0)).alias("slots"),
            item["unit"]["type"].alias("type"),
        ),
    )


def format_slots(fmt: Column | str) -> Column:
    """Number of C arguments an argument format consumes."""
    units = _argument_unit_map()
    return F.aggregate(
        format_tokens(fmt),
        F.lit(0),
        lambda total, token: total + F.coalesce(F.try_element_at(units, token)["slots"], F.lit(0)),
    )


def leading_blanks(names: Column | str) -> Column:
    """Struct(count, error): leading empty keyword names, an error when one comes later."""
    blank = F.transform(col_of(names), lambda n: n == "")
    first_named = F.array_position(blank, False)
    count = F.when(first_named == 0, F.size(blank)).otherwise(first_named - 1).cast("int")
    later = F.exists(F.slice(blank, count + 1, F.greatest(F.size(blank), F.lit(1))), lambda b: b)
    return F.struct(count.alias("count"), F.when(later, F.lit("empty name after a named keyword")).alias("error"))


def _structure_error(body: Column, tokens: Column, keywords: bool, blanks: Column | None) -> Column:
    """First structural error of an argument format, null when well formed."""
    leftover = F.regexp_replace(body, ARGUMENT_PATTERN, "")
    start = F.struct(
        F.lit(0).alias("depth"),
        F.lit(0).alias("section"),
        F.lit(0).alias("units"),
        F.lit("").alias("previous"),
        F.lit(None).cast("string").alias("error"),
    )

    def step(acc: Column, token: Column) -> Column:
        depth, section = acc["depth"], acc["section"]
        if keywords:
            found = (
                F.when(token.isin("(", ")"), F.lit("nested formats need positional parsing"))
                .when((token == "|") & (section == 1), F.lit("repeated |"))
                .when((token == "|") & (section == 2), F.lit("| after $"))
                .when((token == "$") & (acc["units"] < blanks), F.lit("$ before the positional-only names end"))
                .when((token == "$") & (section == 0), F.lit("$ before |"))
                .when((token == "$") & (section == 2), F.lit("repeated $"))
            )
        else:
            found = (
                F.when(token == "$", F.lit("$ needs keyword parsing"))
                .when((token == "|") & (depth > 0), F.lit("| inside a tuple"))
                .when((token == "|") & (section == 1), F.lit("repeated |"))
                .when((token == ")") & (depth == 0), F.lit(") without ("))
                .when((token == ")") & (acc["previous"] == "("), F.lit("empty tuple"))
            )
        return F.struct(
            F.when(token == "(", depth + 1).when(token == ")", depth - 1).otherwise(depth).alias("depth"),
            F.when(token == "|", 1).when(token == "$", 2).otherwise(section).alias("section"),
            F.when(token.isin("|", "$", "(", ")"), acc["units"]).otherwise(acc["units"] + 1).alias("units"),
            token.alias("previous"),
            F.coalesce(acc["error"], found).alias("error"),
        )

    def finish(acc: Column) -> Column:
        return F.coalesce(acc["error"], F.when(acc["depth"] > 0, F.lit("tuple is not closed")))

    folded = F.aggregate(tokens, start, step, finish)
    if keywords:
        # Blank names matter where a ``$`` can come before they end.
        folded = F.when(~F.regexp_like(body, F.lit(KEYWORD_FORM)) | ((blanks > 0) & F.contains(body, F.lit("$"))), folded)
    else:
        folded = F.when(F.regexp_like(body, F.lit(NOT_FLAT)), folded)
    # Tokens and what is left over make up the body.
    return F.coalesce(F.when(F.array_join(tokens, "") != body, F.concat(F.lit("unknown unit: "), leftover)), folded)


def check_format(
    fmt: Column | str, slot_count: Column | str | None = None, names: Column | str | None = None
) -> Column:
    """Error text of an argument format, null when valid.

    With ``names`` the keyword rules apply, otherwise the positional ones with nested tuples.
    """
    read = F.struct(format_body(fmt).alias("body"), format_tokens(fmt).alias("tokens"))
    return let(read, lambda r: _format_error(r["body"], r["tokens"], slot_count, names))


def _format_error(
    body: Column, tokens: Column, slot_count: Column | str | None, names: Column | str | None, wide: Column | None = None
) -> Column:
    if names is None:
        checks = [_structure_error(body, tokens, False, None)]
    else:
        # A struct, as names may be null.
        blanks = F.struct(leading_blanks(names).alias("b"))
        units = F.size(F.filter(tokens, lambda t: ~t.isin("|", "$", "(", ")")))
        checks = [
            let(blanks, lambda b: F.coalesce(b["b"]["error"], _structure_error(body, tokens, True, b["b"]["count"]))),
            F.when(units != F.size(col_of(names)), F.lit("names do not match units")),
        ]
    if slot_count is not None:
        if wide is None:
            wide = F.aggregate(tokens, F.lit(0), lambda total, token: total + F.coalesce(F.try_element_at(_argument_unit_map(), token)["slots"], F.lit(0)))
        checks.append(F.when(wide != col_of(slot_count), F.lit("arguments do not match units")))
    return F.coalesce(*checks)


SLOT = "struct<name:string,type:string,refined:string,default_value:string>"


def parse_format_arguments(fmt: Column | str, slots: Column | str, names: Column | str | None = None) -> Column:
    """Struct(args, error) of an argument format applied to its C arguments.

    ``slots`` is an array of struct(name, type, refined, default_value), one per C argument: the
    variable's name, the type a type object or converter resolves to, the type that object checks
    imply, and the default literal. Missing facts degrade to ``object`` and ``...``.
    """
    fmt, slots = col_of(fmt), col_of(slots)

    def parsed(read: Column) -> Column:
        tokens, items = F.transform(read["items"], lambda i: i["token"]), read["items"]
        wide = F.aggregate(items, F.lit(0), lambda total, i: total + F.coalesce(i["unit"]["slots"], F.lit(0)))
        error = let(F.struct(tokens.alias("tokens")), lambda r: _format_error(read["body"], r["tokens"], F.size(slots), names, wide))
        args = _flat_arguments(items, slots, names)
        if names is None:
            args = F.when(F.contains(fmt, F.lit("(")), _nested_arguments(items, slots)).otherwise(args)
        return let(error, lambda e: F.struct(F.when(e.isNull(), args).alias("args"), e.alias("error")))

    return let(F.struct(format_body(fmt).alias("body"), _with_units(format_tokens(fmt), _argument_unit_map()).alias("items")), parsed)


def _nested_arguments(items: Column, slots: Column) -> Column:
    """Arguments of a positional format with tuples: one fold over its tokens."""
    start = F.struct(
        F.lit(0).alias("slot"),
        F.lit(0).alias("section"),
        F.array().cast("array<int>").alias("counts"),
        F.lit("").alias("type"),
        F.lit("").alias("default"),
        F.lit(False).alias("unknown_default"),
        F.array().cast("array<string>").alias("slot_names"),
        F.array().cast(f"array<{S.ARGUMENT}>").alias("args"),
    )

    def bump(counts: Column) -> Column:
        rest = F.slice(counts, 2, F.greatest(F.size(counts) - 1, F.lit(0)))
        return F.when(F.size(counts) > 0, F.concat(F.array(F.element_at(counts, 1) + 1), rest)).otherwise(counts)

    def step(acc: Column, item: Column) -> Column:
        token, unit = item["token"], item["unit"]
        counts, depth = acc["counts"], F.size(acc["counts"])
        is_unit = unit.isNotNull()
        opens, closes = token == "(", token == ")"
        receiver = F.try_element_at(slots, acc["slot"] + unit["receiver"] + 1)
        resolved = F.when(
            unit["resolved"], F.coalesce(F.try_element_at(slots, acc["slot"] + 1)["type"], F.lit("object"))
        ).otherwise(unit["type"])
        type_text = F.when(resolved == "object", F.coalesce(receiver["refined"], F.lit("object"))).otherwise(resolved)
        default = F.coalesce(receiver["default_value"], F.lit("..."))

        inner_first = F.coalesce(F.try_element_at(counts, F.lit(1)), F.lit(0)) == 0
        separator = F.when((depth > 0) & ~inner_first, F.lit(", ")).otherwise(F.lit(""))
        single = F.when(F.coalesce(F.try_element_at(counts, F.lit(1)), F.lit(0)) == 1, F.lit(",")).otherwise(F.lit(""))
        new_type = (
            F.when(opens, F.concat(acc["type"], separator, F.lit("tuple[")))
            .when(closes, F.concat(acc["type"], single, F.lit("]")))
            .otherwise(F.concat(acc["type"], separator, type_text))
        )
        new_default = (
            F.when(opens, F.concat(acc["default"], separator, F.lit("(")))
            .when(closes, F.concat(acc["default"], single, F.lit(")")))
            .otherwise(F.concat(acc["default"], separator, default))
        )
        new_counts = (
            F.when(opens, F.concat(F.array(F.lit(0)), bump(counts)))
            .when(closes, F.slice(counts, 2, F.greatest(depth - 1, F.lit(0))))
            .when(is_unit, bump(counts))
            .otherwise(counts)
        )
        unknown = acc["unknown_default"] | (is_unit & (default == "..."))
        new_names = F.when(is_unit, F.concat(acc["slot_names"], F.array(receiver["name"]))).otherwise(acc["slot_names"])
        complete = (is_unit & (depth == 0)) | (closes & (depth == 1))

        name, kind = F.array_join(F.array_distinct(new_names), "_"), F.lit(S.POSITIONAL_ONLY)
        argument = F.struct(
            name.alias("name"),
            new_type.alias("type"),
            F.when(acc["section"] > 0, F.when(unknown, F.lit("...")).otherwise(new_default)).alias("default_value"),
            kind.alias("kind"),
        )
        marker = token.isin("|", "$")
        keep = marker | complete
        return F.struct(
            (acc["slot"] + F.coalesce(unit["slots"], F.lit(0))).alias("slot"),
            F.when(token == "|", 1).when(token == "$", 2).otherwise(acc["section"]).alias("section"),
            new_counts.alias("counts"),
            F.when(keep, F.lit("")).otherwise(new_type).alias("type"),
            F.when(keep, F.lit("")).otherwise(new_default).alias("default"),
            F.when(keep, F.lit(False)).otherwise(unknown).alias("unknown_default"),
            F.when(keep, F.array().cast("array<string>")).otherwise(new_names).alias("slot_names"),
            F.when(complete, F.concat(acc["args"], F.array(argument))).otherwise(acc["args"]).alias("args"),
        )

    return F.aggregate(items, start, step, lambda acc: acc["args"])


def _flat_arguments(items: Column, slots: Column, names: Column | str | None = None) -> Column:
    """Arguments of a well-formed format without tuples, which keyword formats never have: one per unit, found by position."""
    units = F.filter(items, lambda i: i["unit"].isNotNull())
    marks = F.transform(items, lambda i: i["token"])
    state = F.struct(
        F.transform(units, lambda i: i["unit"]["slots"]).alias("widths"),
        F.array_position(marks, "|").alias("bar"),
        (F.lit(0) if names is None else F.array_position(marks, "$")).alias("dollar"),
        (F.lit(0) if names is None else leading_blanks(names)["count"]).alias("blanks"),
    )

    def with_state(at: Column) -> Column:
        def argument(item: Column, index: Column) -> Column:
            unit = item["unit"]
            offset = F.aggregate(F.slice(at["widths"], F.lit(1), index), F.lit(0), lambda total, w: total + w)

            def build(first: Column) -> Column:
                receiver = F.try_element_at(slots, first + unit["receiver"])
                resolved = F.when(unit["resolved"], F.coalesce(F.try_element_at(slots, first)["type"], F.lit("object"))).otherwise(unit["type"])
                refined = F.coalesce(receiver["refined"], F.lit("object"))
                optional = (at["bar"] > 0) & (index + 1 >= at["bar"])
                name, kind = receiver["name"], F.lit(S.POSITIONAL_ONLY)
                if names is not None:
                    unnamed = index < at["blanks"]
                    name = F.when(unnamed, name).otherwise(F.try_element_at(col_of(names), index + 1))
                    # A ``$`` stands behind the ``|``.
                    only = (at["dollar"] > 0) & (index + 2 >= at["dollar"])
                    kind = F.when(unnamed, kind).when(only, F.lit(S.KEYWORD_ONLY)).otherwise(F.lit(S.POSITIONAL_OR_KEYWORD))
                return F.struct(
                    name.alias("name"),
                    F.when(resolved == "object", refined).otherwise(resolved).alias("type"),
                    F.when(optional, F.coalesce(receiver["default_value"], F.lit("..."))).alias("default_value"),
                    kind.alias("kind"),
                )

            return let(offset + 1, build)

        return F.transform(units, argument)

    return let(state, with_state)


def value_format_type(fmt: Column | str, arg_types: Column | str | None = None) -> Column:
    """Struct(type, error) of a value format string.

    One fold keeps a stack of open brackets with the items collected so far; an item is the
    array of its flat union members. ``arg_types`` gives the types of object arguments.
    """
    fmt = col_of(fmt)
    given = F.array().cast("array<string>") if arg_types is None else col_of(arg_types)
    leftover = F.regexp_replace(F.regexp_replace(fmt, VALUE_PATTERN, ""), "[ \\t,:]", "")
    tokens = F.regexp_extract_all(fmt, F.lit("(" + VALUE_PATTERN + ")"), F.lit(1))
    items_type = "array<array<string>>"
    start = F.struct(
        F.array().cast(f"array<struct<kind:string,items:{items_type}>>").alias("open"),
        F.array().cast(items_type).alias("items"),
        F.lit("").alias("kind"),
        F.lit(0).alias("slot"),
        F.lit(None).cast("string").alias("error"),
    )

    def element(items: Column, parity: int | None = None) -> Column:
        chosen = items if parity is None else F.filter(items, lambda _, i: i % 2 == parity)
        flat = canonical_members(F.flatten(chosen))
        return F.when(F.size(flat) == 0, F.lit(ANY)).otherwise(F.array_join(flat, " | "))

    def step(acc: Column, item: Column) -> Column:
        token, unit = item["token"], item["unit"]
        opens = token.isin("(", "[", "{")
        closes = token.isin(")", "]", "}")
        expected = F.when(acc["kind"] == "(", ")").when(acc["kind"] == "[", "]").when(acc["kind"] == "{", "}")
        matches = F.coalesce(expected == token, F.lit(False))
        rendered = F.transform(acc["items"], lambda members: F.array_join(members, " | "))
        closed = (
            F.when(
                token == ")",
                F.when(F.size(rendered) == 0, F.lit("tuple[()]"))
                .when(F.size(rendered) == 1, F.concat(F.lit("tuple["), F.element_at(rendered, 1), F.lit(",]")))
                .otherwise(F.concat(F.lit("tuple["), F.array_join(rendered, ", "), F.lit("]"))),
            )
            .when(token == "]", F.concat(F.lit("list["), element(acc["items"]), F.lit("]")))
            .otherwise(
                F.concat(F.lit("dict["), element(acc["items"], 0), F.lit(", "), element(acc["items"], 1), F.lit("]"))
            )
        )
        argument = F.try_element_at(given, acc["slot"] + 1)
        members = F.when(
            unit["resolved"] & argument.isNotNull(), canonical_members(union_members(argument))
        ).otherwise(unit["members"])
        outer = F.try_element_at(acc["open"], F.lit(1))
        return F.struct(
            F.when(
                opens,
                F.concat(F.array(F.struct(acc["kind"].alias("kind"), acc["items"].alias("items"))), acc["open"]),
            )
            .when(closes & matches, F.slice(acc["open"], 2, F.greatest(F.size(acc["open"]) - 1, F.lit(0))))
            .otherwise(acc["open"])
            .alias("open"),
            F.when(opens, F.array().cast(items_type))
            .when(closes & matches, F.concat(outer["items"], F.array(F.array(closed))))
            .when(closes, acc["items"])
            .otherwise(F.concat(acc["items"], F.array(members)))
            .alias("items"),
            F.when(opens, token).when(closes & matches, outer["kind"]).otherwise(acc["kind"]).alias("kind"),
            (acc["slot"] + F.coalesce(unit["slots"], F.lit(0))).alias("slot"),
            F.coalesce(
                acc["error"],
                F.when(closes & ~matches, F.lit("bracket does not match")),
                F.when((token == "}") & (F.size(acc["items"]) % 2 != 0), F.lit("dict needs key and value pairs")),
            ).alias("error"),
        )

    def finish(acc: Column) -> Column:
        rendered = F.transform(acc["items"], lambda members: F.array_join(members, " | "))
        error = F.coalesce(
            acc["error"],
            F.when(acc["kind"] != "", F.lit("bracket is not closed")),
            F.lit(None).cast("string") if arg_types is None
            else F.when(acc["slot"] != F.size(given), F.lit("arguments do not match units")),
        )
        text = (
            F.when(F.size(rendered) == 0, F.lit("None"))
            .when(F.size(rendered) == 1, F.element_at(rendered, 1))
            .otherwise(F.concat(F.lit("tuple["), F.array_join(rendered, ", "), F.lit("]")))
        )
        return F.struct(F.when(error.isNull(), text).alias("type"), error.alias("error"))

    folded = F.aggregate(_with_units(tokens, _value_unit_map()), start, step, finish)
    unknown = F.when(leftover != "", F.concat(F.lit("unknown unit: "), leftover))
    failed = F.struct(F.lit(None).cast("string").alias("type"), unknown.alias("error"))
    return F.when(unknown.isNotNull(), failed).otherwise(folded)
