"""Signature texts parsed into argument arrays."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from apisurface import schemas as S
from apisurface.functions.text import col_of, literal_map, strip
from apisurface.functions.types import let, split_top_level, union_text

def _null_text() -> Column:
    return F.lit(None).cast("string")


def _argument(name: Column, type_text: Column, default: Column, kind: Column) -> Column:
    return F.struct(
        name.alias("name"), type_text.alias("type"), default.alias("default_value"), kind.alias("kind")
    )


def _declaration(part: Column) -> Column:
    """Struct(name, type, default, error) of one ``name: type = default`` block."""

    def from_halves(by_default: Column) -> Column:
        halves = by_default["parts"]

        def from_named(by_type: Column) -> Column:
            pieces = by_type["parts"]
            annotated = F.size(pieces) > 1
            annotation = strip(F.array_join(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1))), ":"))
            return F.struct(
                strip(F.element_at(pieces, 1)).alias("name"),
                F.when(annotated, annotation).alias("type"),
                strip(F.try_element_at(halves, F.lit(2))).alias("default"),
                F.coalesce(
                    F.when(strip(part) == "", F.lit("empty argument")),
                    by_default["error"],
                    F.when(F.size(halves) > 2, F.lit("more than one =")),
                    by_type["error"],
                    F.when(annotated & (annotation == ""), F.lit("empty annotation")),
                ).alias("error"),
            )

        return let(split_top_level(F.element_at(halves, 1), ":"), from_named)

    return let(split_top_level(part, "="), from_halves)


def _arguments_from_declarations(declarations: Column) -> Column:
    """Struct(args, error); sections are 0 positional, 1 after ``/``, 2 keyword-only, 3 finished."""
    start = F.struct(
        F.lit(0).alias("section"),
        F.array().cast(f"array<{S.ARGUMENT}>").alias("args"),
        _null_text().alias("error"),
    )
    ordinary = S.POSITIONAL_OR_KEYWORD

    def step(acc: Column, item: Column) -> Column:
        section, name = acc["section"], item["name"]
        bare = item["type"].isNull() & item["default"].isNull()
        slash, star = name == "/", name == "*"
        var_keyword = F.startswith(name, F.lit("**"))
        var_positional = F.startswith(name, F.lit("*")) & ~var_keyword & ~star
        has_ordinary = F.exists(acc["args"], lambda a: a["kind"] == ordinary)
        plain_name = (
            F.when(var_keyword, strip(F.substring(name, F.lit(3), F.length(name))))
            .when(var_positional, strip(F.substring(name, F.lit(2), F.length(name))))
            .otherwise(name)
        )
        kind = (
            F.when(var_keyword, F.lit(S.VAR_KEYWORD))
            .when(var_positional, F.lit(S.VAR_POSITIONAL))
            .when(section == 2, F.lit(S.KEYWORD_ONLY))
            .otherwise(F.lit(ordinary))
        )
        error = (
            F.when(item["error"].isNotNull(), item["error"])
            .when(section == 3, F.lit("argument after **"))
            .when(slash & ((section != 0) | ~bare), F.lit("/ is misplaced"))
            .when(slash & ~has_ordinary, F.lit("/ without an argument before it"))
            .when(star & ((section >= 2) | ~bare), F.lit("* is misplaced"))
            .when(var_positional & (section >= 2), F.lit("variadic argument is misplaced"))
            .when((var_keyword | var_positional) & item["default"].isNotNull(), F.lit("variadic argument with default"))
            .when(plain_name == "", F.lit("argument without name"))
            .when(~(slash | star | var_keyword | var_positional) & item["type"].isNull(), F.lit("argument without type"))
        )
        positional = F.transform(
            acc["args"],
            lambda a: _argument(
                a["name"],
                a["type"],
                a["default_value"],
                F.when(a["kind"] == ordinary, F.lit(S.POSITIONAL_ONLY)).otherwise(a["kind"]),
            ),
        )
        appended = F.concat(acc["args"], F.array(_argument(plain_name, item["type"], item["default"], kind)))
        return F.struct(
            F.when(slash, 1).when(star | var_positional, 2).when(var_keyword, 3).otherwise(section).alias("section"),
            F.when(slash, positional).when(star, acc["args"]).otherwise(appended).alias("args"),
            F.coalesce(acc["error"], error).alias("error"),
        )

    return F.aggregate(declarations, start, step, lambda acc: F.struct(acc["args"], acc["error"]))


def _overload_halves(body: Column) -> Column:
    """Array of the one struct(args, returns), cut at the last arrow that a closing bracket precedes and a type follows."""
    pieces = F.split(body, "->", -1)

    def cut(k: Column) -> Column:
        head = strip(F.array_join(F.slice(pieces, F.lit(1), k), "->"))
        tail = strip(F.array_join(F.slice(pieces, k + 1, F.size(pieces)), "->"))
        return F.struct(head.alias("head"), tail.alias("returns"))

    def whole(h: Column) -> Column:
        head = h["head"]
        bracketed = F.startswith(head, F.lit("(")) & F.endswith(head, F.lit(")")) & (F.length(head) > 1)
        return bracketed & (h["returns"] != "")

    places = F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 1)).otherwise(F.array().cast("array<int>"))
    fits = F.filter(F.transform(places, cut), whole)
    return F.transform(
        F.slice(fits, F.greatest(F.size(fits), F.lit(1)), F.lit(1)),
        lambda h: F.struct(F.substring(h["head"], F.lit(2), F.length(h["head"]) - 2).alias("args"), h["returns"].alias("returns")),
    )


def parse_overload(text: Column | str) -> Column:
    """Struct(args, return_type, error) of an overload text ``(args) -> type``."""
    return let(F.try_element_at(_overload_halves(strip(text)), F.lit(1)), _parsed_overload)


def _parsed_overload(halves: Column) -> Column:
    matches = halves.isNotNull()
    args_text = F.coalesce(halves["args"], F.lit(""))
    returns = halves["returns"]

    def from_parts(split: Column) -> Column:
        empty = strip(args_text) == ""
        parts = F.when(empty, F.array().cast("array<string>")).otherwise(split["parts"])
        parsed = _arguments_from_declarations(F.transform(parts, _declaration))

        def from_parsed(result: Column) -> Column:
            error = F.coalesce(
                F.when(~matches, F.lit("not an overload text")), split["error"], result["error"]
            )
            return F.struct(
                F.when(error.isNull(), result["args"]).alias("args"),
                F.when(error.isNull(), returns).alias("return_type"),
                error.alias("error"),
            )

        return let(parsed, from_parsed)

    return let(split_top_level(args_text, ","), from_parts)


# Declared parameter types and their Python types.
PARAMETER_TYPES = {
    "Tensor": "torch.Tensor",
    "Scalar": "torch.types.Number",
    "int64_t": "int",
    "DeviceIndex": "int",
    "SymInt": "torch.SymInt",
    "double": "float",
    "complex": "complex",
    "TensorList": "collections.abc.Sequence[torch.Tensor]",
    "c10::List<::std::optional<Tensor>>": "collections.abc.Sequence[torch.Tensor | None]",
    "IntArrayRef": "torch.types._size",
    "SymIntArrayRef": "torch.types._symsize",
    "ArrayRef<double>": "collections.abc.Sequence[float]",
    "Generator": "torch.Generator",
    "bool": "bool",
    "Storage": "torch.Storage",
    "PyObject*": "object",
    "ScalarType": "torch.dtype",
    "Layout": "torch.layout",
    "MemoryFormat": "torch.memory_format",
    "QScheme": "torch.qscheme",
    "Device": "torch.device",
    "Stream": "torch.Stream",
    "std::string": "str",
    "c10::string_view": "str",
    "std::string_view": "str",
    "::std::string_view": "str",
    "Dimname": "str",
    "DimnameList": "collections.abc.Sequence[str]",
    "ScalarList": "collections.abc.Sequence[torch.types.Number]",
    "DispatchKeySet": "torch.DispatchKeySet",
}

# Suffixes of signatures that are not shown.
HIDDEN_SUFFIXES = ["hidden", "deprecated"]


def _delimited_parts(text: Column) -> Column:
    """Struct(name, params, suffix, valid): cut at the first ``(`` and the last ``)``; what follows is empty or ``|suffix``."""
    opening = F.instr(text, "(")
    closing = F.length(text) - F.instr(F.reverse(text), ")") + 1
    places = F.struct(opening.alias("opening"), closing.alias("closing"))

    def cut(at: Column) -> Column:
        whole = (at["opening"] > 1) & F.contains(text, F.lit(")")) & (at["closing"] > at["opening"])
        name = F.left(text, at["opening"] - 1)
        params = F.substring(text, at["opening"] + 1, at["closing"] - at["opening"] - 1)
        tail = F.substring(text, at["closing"] + 1, F.length(text))
        return F.when(whole, F.struct(name.alias("name"), params.alias("params"), tail.alias("tail")))

    def judged(cuts: Column) -> Column:
        name, params, tail = cuts["name"], cuts["params"], cuts["tail"]
        suffixed = F.startswith(tail, F.lit("|")) & (F.length(tail) > 1)
        suffix = F.when(suffixed, F.substring(tail, F.lit(2), F.length(tail)))
        clean = ~F.contains(name, F.lit(")")) & ~F.contains(name, F.lit("|")) & ~F.contains(F.coalesce(suffix, F.lit("")), F.lit("|"))
        valid = cuts.isNotNull() & clean & ((tail == "") | suffixed) & ~F.contains(params, F.lit("\n"))
        return F.struct(name.alias("name"), params.alias("params"), suffix.alias("suffix"), F.coalesce(valid, F.lit(False)).alias("valid"))

    return let(let(places, cut), judged)


def signature_suffix(text: Column | str) -> Column:
    """Suffix after ``|``, null when there is none."""
    return let(_delimited_parts(col_of(text)), lambda p: F.when(p["valid"], p["suffix"]))


def _parameter_parts(param: Column) -> Column:
    """Struct(name, default, base, optional, bad_param, bad_type) of ``Type[n]? name=default``."""

    def from_halves(halves: Column) -> Column:
        declared = strip(F.get(halves, F.lit(1)))
        type_text = F.get(halves, F.lit(0))
        optional = F.endswith(type_text, F.lit("?"))
        bare = F.when(optional, F.left(type_text, F.length(type_text) - 1)).otherwise(type_text)
        pair = F.struct(type_text.alias("type_text"), F.split(declared, "=", 2).alias("pair"), optional.alias("optional"), bare.alias("bare"), F.instr(bare, "[").alias("opening"))
        return let(pair, from_pair)

    def from_pair(p: Column) -> Column:
        name, default, bare, opening = F.get(p["pair"], F.lit(0)), F.get(p["pair"], F.lit(1)), p["bare"], p["opening"]
        spaced = F.regexp_like(name, F.lit("(?U)\\s"))
        bad_param = (p["type_text"] == "") | p["pair"].isNull() | (name == "") | spaced | F.coalesce(default == "", F.lit(False))
        base = F.when(opening > 0, F.left(bare, opening - 1)).otherwise(bare)
        size = F.substring(bare, opening + 1, F.length(bare) - opening - 1)
        sized = F.endswith(bare, F.lit("]")) & (size != "") & (F.translate(size, "0123456789", "") == "")
        bad_type = (base == "") | (F.translate(base, "[]?", "") != base) | ((opening > 0) & ~sized)
        return F.struct(
            name.alias("name"),
            default.alias("default"),
            base.alias("base"),
            p["optional"].alias("optional"),
            F.coalesce(bad_param, F.lit(True)).alias("bad_param"),
            F.coalesce(bad_type, F.lit(True)).alias("bad_type"),
        )

    return let(F.split(param, "(?U)\\s", 2), from_halves)


def parse_delimited_signature(text: Column | str, types: Mapping[str, str] = PARAMETER_TYPES) -> Column:
    """Struct(name, args, hidden, error) of ``name(Type a, Type? b=None, *, T c)|suffix``."""
    return let(_delimited_parts(col_of(text)), lambda parts: _delimited_signature(parts, types))


def _delimited_signature(parts: Column, types: Mapping[str, str]) -> Column:
    valid, suffix = parts["valid"], parts["suffix"]
    params_text = F.when(valid, parts["params"]).otherwise(F.lit(""))
    hidden = F.coalesce(valid & suffix.isin(*HIDDEN_SUFFIXES), F.lit(False))
    listed = F.when(params_text == "", F.array().cast("array<string>")).otherwise(F.split(params_text, ", ", -1))
    known = literal_map(types)

    def from_params(params: Column) -> Column:
        read = F.transform(params, lambda p, i: F.struct((p == "*").alias("star"), F.when(p != "*", _parameter_parts(p)).alias("p"), i.alias("i")))
        state = F.struct(
            F.filter(read, lambda x: ~x["star"]).alias("real"), F.array_position(params, "*").alias("star_at"), F.array_contains(params, "").alias("empty"),
            hidden.alias("hidden"),
        )
        return let(state, from_read)

    def from_read(state: Column) -> Column:
        real, star_at = state["real"], state["star_at"]

        def build(p: Column, index: Column) -> Column:
            optional = p["optional"] | F.coalesce(p["default"] == "None", F.lit(False))
            keyword_only = (star_at > 0) & (index >= star_at)
            type_text = let(F.coalesce(F.try_element_at(known, p["base"]), p["base"]), lambda m: F.when(optional, union_text(F.array(m, F.lit("None")))).otherwise(m))
            return _argument(p["name"], type_text, p["default"], F.when(keyword_only, F.lit(S.KEYWORD_ONLY)).otherwise(F.lit(S.POSITIONAL_OR_KEYWORD)))

        error = (
            F.when(~valid, F.lit("not a delimited signature"))
            .when(suffix.isNotNull() & ~state["hidden"], F.concat(F.lit("unknown suffix: "), suffix))
            .when(state["hidden"], _null_text())
            .when(state["empty"], F.lit("empty parameter"))
            .when(F.exists(real, lambda x: x["p"]["bad_param"]), F.lit("parameter is malformed"))
            .when(F.exists(real, lambda x: x["p"]["bad_type"]), F.lit("parameter type is malformed"))
        )
        args = F.transform(real, lambda x: build(x["p"], x["i"]))
        return let(
            error,
            lambda e: F.struct(
                F.when(valid, parts["name"]).alias("name"),
                F.when(e.isNull() & ~state["hidden"], args).alias("args"),
                state["hidden"].alias("hidden"),
                e.alias("error"),
            ),
        )

    return let(listed, from_params)


def triplet_arguments(values: Column | str, slots: Column | str) -> Column:
    """Struct(args, error) of name triplets applied to their slots.

    ``slots`` is an array of struct(name, type, refined, default_value), one per triplet: the variable, the type its converter
    resolves to, the type that checks on the variable imply, and the default of an optional one. Missing facts degrade to ``object``
    and ``...``.
    """
    slots = col_of(slots)

    def built(parsed: Column) -> Column:
        def argument(item: Column, i: Column) -> Column:
            slot = F.get(slots, i)
            known = F.coalesce(slot["type"], F.lit("object"))
            return _argument(
                F.when(item["kind"] == S.POSITIONAL_ONLY, F.coalesce(slot["name"], item["name"])).otherwise(item["name"]),
                F.when(known == "object", F.coalesce(slot["refined"], F.lit("object"))).otherwise(known),
                F.when(item["optional"], F.coalesce(slot["default_value"], F.lit("..."))),
                item["kind"],
            )

        return F.struct(F.transform(parsed["items"], argument).alias("args"), parsed["error"].alias("error"))

    return let(parse_name_triplets(values), built)


def parse_name_spec(spec: Column | str) -> Column:
    """Struct(name, kind, optional) of a prefixed argument name."""
    spec = col_of(spec)
    dollar, bar = F.startswith(spec, F.lit("$")), F.startswith(spec, F.lit("|"))
    name = F.when(dollar | bar, F.substring(spec, F.lit(2), F.length(spec))).otherwise(spec)
    kind = (
        F.when(dollar, F.lit(S.KEYWORD_ONLY))
        .when(name == "", F.lit(S.POSITIONAL_ONLY))
        .otherwise(F.lit(S.POSITIONAL_OR_KEYWORD))
    )
    return F.struct(name.alias("name"), kind.alias("kind"), (dollar | bar).alias("optional"))


def parse_name_triplets(values: Column | str) -> Column:
    """Struct(items, error) of flat ``name, converter, slot`` triplets ended by three nulls."""
    values = col_of(values)
    size = F.size(values)
    whole = (size >= 3) & (size % 3 == 0)
    starts = F.when(whole, F.sequence(F.lit(1), F.greatest(size - 2, F.lit(1)), F.lit(3))).otherwise(
        F.array().cast("array<int>")
    )
    triplets = F.transform(
        starts,
        lambda i: F.struct(
            F.try_element_at(values, i).alias("name"),
            F.try_element_at(values, i + 1).alias("converter"),
            F.try_element_at(values, i + 2).alias("slot"),
        ),
    )
    ends = F.transform(triplets, lambda t: t["name"].isNull() & t["converter"].isNull() & t["slot"].isNull())
    end = F.array_position(ends, True)
    used = F.when(end == 0, triplets).otherwise(F.slice(triplets, F.lit(1), (end - 1).cast("int")))
    error = (
        F.when(~whole, F.lit("length is not a multiple of three"))
        .when((end > 0) & (end != F.size(triplets)), F.lit("arguments after the end mark"))
        .when(F.exists(used, lambda t: t["name"].isNull()), F.lit("name is missing"))
        .when(F.exists(used, lambda t: t["slot"].isNull()), F.lit("slot is missing"))
    )

    def item(triplet: Column) -> Column:
        spec = parse_name_spec(triplet["name"])
        return F.struct(
            F.when(spec["name"] == "", triplet["slot"]).otherwise(spec["name"]).alias("name"),
            triplet["converter"].alias("converter"),
            triplet["slot"].alias("slot"),
            spec["kind"].alias("kind"),
            spec["optional"].alias("optional"),
        )

    return F.struct(F.when(error.isNull(), F.transform(used, item)).alias("items"), error.alias("error"))
