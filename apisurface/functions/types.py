"""Type texts: splitting at top level and canonical unions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apisurface.functions.text import col_of, strip

ANY = "typing.Any"
NEVER = "Never"
_CLOSERS = {"(": ")", "[": "]", "{": "}", "<": ">"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def evaluate_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters and projections use without evaluating it again.

    The optimizer inlines a projected expression into every place that refers to it; it does not
    do so across a generator. Of a plain ``explode`` it would evaluate the array once more, to leave out empty ones.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def split_top_level(text: Column | str, delimiter: str) -> Column:
    """Struct(parts, error): text split at ``delimiter`` outside brackets and quotes.

    A text without brackets and quotes is split as it is. Any other is cut into brackets, delimiters and runs of anything else,
    which may hold quoted strings and pairs of brackets with nothing but strings inside; one fold over these pieces keeps the
    stack of open brackets.
    """
    return let(col_of(text), lambda whole: _split_top_level(whole, delimiter))


_BRACKETS = "()\\[\\]{}<>\"'"
_STRING = "\"[^\"\\\\]*+(?:\\\\.[^\"\\\\]*+)*+\"|'[^'\\\\]*+(?:\\\\.[^'\\\\]*+)*+'"
_PAIRS = "|".join(f"\\{o}(?:[^{_BRACKETS}]++|{_STRING})*+\\{c}" if o != "<" else f"<(?:[^{_BRACKETS}]++|{_STRING})*+>" for o, c in _CLOSERS.items())


def _split_top_level(text: Column, delimiter: str) -> Column:
    pattern = f"(?s)(?:[^{_BRACKETS}\\{delimiter}]++|{_STRING}|{_PAIRS})++|."
    pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    plain = F.struct(F.split(text, f"\\Q{delimiter}\\E", -1).alias("parts"), F.lit(None).cast("string").alias("error"))
    start = F.struct(
        F.lit("").alias("open"),
        F.array().cast("array<string>").alias("parts"),
        F.lit("").alias("current"),
        F.lit(None).cast("string").alias("error"),
    )

    def step(acc: Column, piece: Column) -> Column:
        opened, current = acc["open"], acc["current"]
        closer = F.when(piece == "(", ")").when(piece == "[", "]").when(piece == "{", "}").when(piece == "<", ">")
        closes = piece.isin(*_CLOSERS.values())
        matches = F.substring(opened, 1, 1) == piece
        cut = (opened == "") & (piece == delimiter)
        return F.struct(
            F.when(closer.isNotNull(), F.concat(closer, opened))
            .when(closes & matches, F.substring(opened, F.lit(2), F.length(opened)))
            .otherwise(opened)
            .alias("open"),
            F.when(cut, F.concat(acc["parts"], F.array(current))).otherwise(acc["parts"]).alias("parts"),
            F.when(cut, F.lit("")).otherwise(F.concat(current, piece)).alias("current"),
            F.coalesce(
                acc["error"],
                F.when(piece.isin('"', "'"), F.lit("unclosed string literal")),
                F.when(closes & ~matches, F.lit("brackets do not match")),
            ).alias("error"),
        )

    def finish(acc: Column) -> Column:
        return F.struct(
            F.concat(acc["parts"], F.array(acc["current"])).alias("parts"),
            F.coalesce(acc["error"], F.when(acc["open"] != "", F.lit("bracket is not closed"))).alias("error"),
        )

    return F.when(~F.regexp_like(text, F.lit(f"[{_BRACKETS}]")), plain).otherwise(F.aggregate(pieces, start, step, finish))


def union_members(text: Column | str) -> Column:
    """Members of a rendered union; brackets and quotes protect inner bars."""
    text = col_of(text)
    plain = F.array(text)
    return F.when(~F.contains(text, F.lit("|")), plain).otherwise(
        F.transform(split_top_level(text, "|")["parts"], strip)
    )


def canonical_members(members: Column | str, drop_none: bool = False) -> Column:
    """Flat members of a union: distinct, sorted, only ``typing.Any`` when that occurs.

    ``Never``, null and empty members vanish.
    """
    known = F.filter(col_of(members), lambda m: m.isNotNull() & ~m.isin("", NEVER))
    if drop_none:
        known = F.filter(known, lambda m: m != "None")
    return let(known, lambda k: F.when(F.array_contains(k, ANY), F.array(F.lit(ANY))).otherwise(F.sort_array(F.array_distinct(k))))


def union_text(members: Column | str, drop_none: bool = False) -> Column:
    """Rendered union of flat members; null for Never."""
    flat = canonical_members(members, drop_none)
    return let(F.array_join(flat, " | "), lambda text: F.when(text != "", text))


def union_of_texts(texts: Column | str, drop_none: bool = False) -> Column:
    """Rendered union of rendered types, nested unions flattened; null for Never."""
    members = F.flatten(F.transform(F.filter(col_of(texts), lambda t: t.isNotNull()), union_members))
    return union_text(members, drop_none)


def type_imports(text: Column | str) -> Column:
    """Sorted modules a type text refers to: its dotted names without the last part."""
    bare = F.regexp_replace(col_of(text), "\"[^\"]*\"", "")
    dotted = F.regexp_extract_all(bare, F.lit("((?:[A-Za-z_]\\w*\\.)+)[A-Za-z_]\\w*"), F.lit(1))
    modules = F.transform(dotted, lambda d: F.regexp_replace(d, "(\\.core)?\\.$", ""))
    return F.sort_array(F.array_distinct(modules))


__all__ = [
    "ANY",
    "NEVER",
    "canonical_members",
    "evaluate_once",
    "let",
    "split_top_level",
    "type_imports",
    "union_members",
    "union_of_texts",
    "union_text",
]
