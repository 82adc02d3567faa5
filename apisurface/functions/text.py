"""Column functions over names, URLs, paths, docs and source text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space when text is trimmed.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_SPACE = "[\\s\\x1c-\\x1f\\x85]"

# Fixed value: project-URL labels in order of preference.
URL_LABELS = ["Source", "Code", "Homepage", "GitHub", "Repository"]


def col_of(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Text without leading and trailing white space."""
    return F.btrim(col_of(value), F.lit(WHITESPACE))


def blank_to_null(value: Column | str) -> Column:
    """Null for empty or white-space-only text, otherwise the text as it is."""
    value = col_of(value)
    return F.when(strip(value) != "", value)


def name_parts(value: Column | str, sep: str = ".") -> Column:
    """Parts, parent and leaf of a separated name."""
    parts = F.split(col_of(value), "\\Q" + sep + "\\E")
    return F.struct(
        parts.alias("parts"),
        F.array_join(F.slice(parts, 1, F.size(parts) - 1), sep).alias("parent"),
        F.element_at(parts, -1).alias("leaf"),
    )


def concat_name(parent: Column | str, leaf: Column | str, sep: str = ".") -> Column:
    parent, leaf = col_of(parent), col_of(leaf)
    return F.when(F.coalesce(parent, F.lit("")) == "", leaf).otherwise(F.concat(parent, F.lit(sep), leaf))


def function_id(module: Column | str, class_name: Column | str, function: Column | str) -> Column:
    """``module:function`` or ``module:Class.function``."""
    module, class_name, function = col_of(module), col_of(class_name), col_of(function)
    owner = F.when(class_name.isNull(), F.lit("")).otherwise(F.concat(class_name, F.lit(".")))
    return F.concat(module, F.lit(":"), owner, function)


def parse_repo_url(url: Column | str, host: str = "github.com") -> Column:
    """Struct(owner, repo) of a repository URL on ``host``; null when there is none.

    The path behind the host is cut at slashes: the first part is the owner, the second, up to a query or fragment and
    without a closing ``.git``, the repository. Where the host occurs again, its first place with both parts counts.
    """
    url = col_of(url)
    pieces = F.split(url, "\\Q" + host + "/\\E", -1)

    def path_behind(place: Column) -> Column:
        path = F.array_join(F.slice(pieces, place + 1, F.size(pieces)), host + "/")
        parts = F.split(path, "/", -1)
        name = F.get(parts, F.lit(1))
        closing = (F.size(parts) == 2) & F.endswith(name, F.lit(".git"))
        name = F.when(closing, F.left(name, F.length(name) - 4)).otherwise(name)
        return F.struct(F.get(parts, F.lit(0)).alias("owner"), F.element_at(F.split(name, "[?#]", -1), 1).alias("repo"))

    places = F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 1)).otherwise(F.array().cast("array<int>"))
    found = F.filter(F.transform(places, path_behind), lambda r: (r["owner"] != "") & (r["repo"] != ""))
    return F.try_element_at(found, F.lit(1))


def pick_url(urls: Column | str, host: str = "github.com", labels: Sequence[str] = URL_LABELS) -> Column:
    """Repository of the first usable labelled URL, else of the first usable value of the map."""
    urls = col_of(urls)
    labelled = F.array(*[parse_repo_url(F.try_element_at(urls, F.lit(label)), host) for label in labels])
    others = F.transform(F.map_values(urls), lambda u: parse_repo_url(u, host))
    usable = F.filter(F.concat(labelled, others), lambda r: r.isNotNull())
    return F.try_element_at(usable, F.lit(1))


def first_identifier(text: Column | str) -> Column:
    """First C identifier in the text, null when there is none."""
    found = F.regexp_extract(col_of(text), "(?U)\\b[_A-Za-z]\\w*\\b", 0)
    return F.when(found != "", found)


def type_object_name(text: Column | str) -> Column:
    """Name of a type-object operand: white space and one leading ``&`` removed."""
    stripped = strip(text)
    return F.when(F.startswith(stripped, F.lit("&")), strip(F.substring(stripped, F.lit(2), F.length(stripped)))).otherwise(
        stripped
    )


#: Signs of a type text that take no blank beside them.
TYPE_SIGNS = "<>,*&"


def normalize_type(text: Column | str) -> Column:
    """C++ type text without qualifiers and needless white space.

    Words are cut at white space and joined by one blank, which goes beside signs; a ``const`` that more follows goes; up to two
    ``&`` at the end go.
    """
    words = F.split(strip(text), f"(?U){_SPACE}+")
    told = F.array_join(words, " ")
    bare = F.when(F.contains(told, F.lit("const ")), F.regexp_replace(told, "\\bconst ", "")).otherwise(told)
    close = F.regexp_replace(bare, f" ?([{TYPE_SIGNS}]) ?", "$1")
    ends = F.when(F.endswith(close, F.lit("&&")), 2).when(F.endswith(close, F.lit("&")), 1).otherwise(0)
    return F.left(close, F.length(close) - ends)


# C++ types a wrapped return value may have, and their Python types.
CPP_TYPES = {
    "bool": "bool",
    "c10::DeviceIndex": "int",
    "int64_t": "int",
    "double": "float",
    "at::Tensor": "torch.Tensor",
    "at::TensorList": "tuple[torch.Tensor, ...]",
    "at::Stream": "torch.Stream",
    "c10::Stream": "torch.Stream",
    "at::ScalarType": "torch.dtype",
    "c10::ScalarType": "torch.dtype",
    "THPDtype*": "torch.dtype",
    "at::Layout": "torch.layout",
    "c10::Layout": "torch.layout",
    "THPLayout*": "torch.layout",
    "at::QScheme": "torch.qscheme",
    "c10::QScheme": "torch.qscheme",
    "at::IntArrayRef": "tuple[int, ...]",
    "c10::ArrayRef<int64_t>": "tuple[int, ...]",
    "c10::ArrayRef<at::Tensor>": "tuple[torch.Tensor, ...]",
    "c10::ArrayRef<long>": "tuple[int, ...]",
    "c10::ArrayRef<long int>": "tuple[int, ...]",
    "c10::ArrayRef<long long>": "tuple[int, ...]",
    "c10::ArrayRef<long long int>": "tuple[int, ...]",
}


def literal_map(values: Mapping[str, str]) -> Column:
    """Small fixed table as one literal map, folded to a constant by the optimizer."""
    quoted = ["'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for pair in values.items() for x in pair]
    return F.expr(f"map({', '.join(quoted)})")


def cpp_return_type(text: Column | str, types: Mapping[str, str] = CPP_TYPES) -> Column:
    """Python type of a wrapped C++ value; null when the type is not known."""
    return F.try_element_at(literal_map(types), normalize_type(text))


def escape_doc(text: Column | str) -> Column:
    """Docstring text with backslashes and triple quotes escaped."""
    doubled = F.replace(col_of(text), F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit('"""'), F.lit('\\"\\"\\"'))


def doc_lines(text: Column | str) -> Column:
    """Lines of a rendered docstring, quotes included."""
    lines = F.split(col_of(text), "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
    last_is_empty = F.element_at(lines, -1) == ""
    lines = F.when(last_is_empty, F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    quotes = F.array(F.lit('"""'))
    return F.concat(quotes, F.transform(lines, escape_doc), quotes)


def decode_ignoring(data: Column) -> Column:
    """UTF-8 text of a binary value with invalid bytes left out."""
    mark, stand_in = F.lit("\ufffd"), F.lit("\U0010ffff")
    text = data.cast("string")
    repaired = F.replace(F.make_valid_utf8(F.replace(text, mark, stand_in)), mark, F.lit(""))
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(repaired, stand_in, mark))


def slice_source(data: Column | str, start: Column | str, end: Column | str) -> Column:
    """Struct(text, error) for the byte range ``[start, end)`` of a source file."""
    data, start, end = col_of(data).cast("binary"), col_of(start), col_of(end)
    negative = end < start
    length = F.greatest(end - start, F.lit(0)).cast("int")
    piece = F.substring(data, (start + 1).cast("int"), length)
    return F.struct(
        F.when(~negative, decode_ignoring(piece)).alias("text"),
        F.when(negative, F.lit("range ends before it starts")).alias("error"),
    )


def join_path(directory: Column | str, name: Column | str) -> Column:
    """``name`` when absolute or without a directory, otherwise ``directory/name``."""
    directory, name = col_of(directory), col_of(name)
    base = F.when(F.endswith(directory, F.lit("/")), directory).otherwise(F.concat(directory, F.lit("/")))
    no_base = directory.isNull() | (directory == "")
    return F.when(F.startswith(name, F.lit("/")) | no_base, name).otherwise(F.concat(base, name))


def join_names(names: Column | str, sep: str = "_") -> Column:
    """Distinct names in order of first occurrence, joined."""
    return F.array_join(F.array_distinct(col_of(names)), sep)


def python_string(text: Column | str) -> Column:
    """Text as a Python string literal."""
    text = col_of(text)
    quote = F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), F.lit('"')).otherwise(F.lit("'"))
    fixed = {"\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}

    def escaped(char: Column) -> Column:
        rule = F.when((char == "'") & (quote == "'"), F.lit("\\'"))
        for plain, literal in fixed.items():
            rule = rule.when(char == plain, F.lit(literal))
        control = (F.ascii(char) < 32) | (F.ascii(char) == 127)
        return rule.when(control, F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(F.ascii(char)), 2, "0")))).otherwise(char)

    body = F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), escaped), "")
    return F.concat(quote, body, quote)


def python_float(value: Column | str) -> Column:
    """Float text as Python prints it."""
    value = col_of(value).cast("double")
    text = value.cast("string")
    mantissa = F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), "\\.0$", "")
    digits = F.nullif(F.split_part(text, F.lit("E"), F.lit(2)), F.lit(""))
    exponent = F.coalesce(digits.cast("int"), F.lit(0))
    plain = F.regexp_replace(value.try_cast("decimal(38,20)").cast("string"), "(\\.\\d+?)0+$", "$1")
    sign = F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+"))
    scientific = F.concat(mantissa, F.lit("e"), sign, F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    return (
        F.when(F.isnan(value), F.lit("nan"))
        .when(value == float("inf"), F.lit("inf"))
        .when(value == float("-inf"), F.lit("-inf"))
        .when(~F.contains(text, F.lit("E")), text)
        .when(exponent.between(-4, 15), plain)
        .otherwise(scientific)
    )


# Singleton objects and the literals they stand for.
SINGLETONS = {"_Py_NoneStruct": "None", "_Py_TrueStruct": "True", "_Py_FalseStruct": "False"}


def render_default(
    kind: Column | str,
    is_pointer: Column | str,
    expected_type: Column | str,
    text: Column | str,
    number: Column | str,
) -> Column:
    """Struct(default_value, error) for a C default expression.

    ``kind`` is one of null, string, float, bool, integer, unary; ``text`` holds string content or the
    name an address-of operand refers to; ``number`` holds the evaluated number, as a number or its text. Whole numbers
    of up to 38 digits are kept exactly.
    """
    kind, is_pointer, expected_type = col_of(kind), col_of(is_pointer), col_of(expected_type)
    text, digits, number = col_of(text), col_of(number).cast("string"), col_of(number).cast("double")
    exact = F.when(F.rlike(digits, F.lit("^[+-]?[0-9]+$")), digits.try_cast("decimal(38,0)").cast("string"))
    short = F.when(number == F.floor(number), number.try_cast("decimal(38,0)").cast("string"))
    whole = F.coalesce(exact, short, python_float(number))
    as_number = F.when(expected_type == "float", python_float(number)).when(kind == "float", python_float(number)).otherwise(whole)
    as_bool = F.when(number == 0, F.lit("False")).when(number == 1, F.lit("True"))
    value = (
        F.when(is_pointer & (kind == "null"), F.lit("..."))
        .when(kind == "string", python_string(text))
        .when(kind == "float", as_number)
        .when((kind == "bool") & (expected_type == "bool"), as_bool)
        .when(kind == "bool", as_number)
        .when((kind == "integer") & ~is_pointer & (expected_type == "bool"), as_bool)
        .when((kind == "integer") & ~is_pointer, as_number)
        .when((kind == "unary") & text.isin(*SINGLETONS), F.try_element_at(literal_map(SINGLETONS), text))
        .when((kind == "unary") & ~is_pointer, as_number)
    )
    return F.struct(
        value.alias("default_value"),
        F.when(value.isNull(), F.concat(F.lit("unsupported default: "), F.coalesce(kind, F.lit("none")))).alias("error"),
    )
