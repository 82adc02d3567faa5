import pytest
from pyspark.sql import functions as F

from apisurface.functions import formats, signatures, text, types


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in SCHEMA(values).items()))
    return row.select(column.alias("r")).first()["r"]


def SCHEMA(values):
    kinds = {str: "string", int: "int", float: "double", bool: "boolean", list: "array<string>", type(None): "string"}
    return {k: kinds[type(v)] for k, v in values.items()}


VALUE_GOLDEN = {
    "": "None",
    "()": "tuple[()]",
    "[]": "list[typing.Any]",
    "{}": "dict[typing.Any, typing.Any]",
    "(i)": "tuple[int,]",
    "[szuU]": "list[None | str]",
    "{syUy}": "dict[None | str, None | bytes]",
    "c": "bytes",
    "ii": "tuple[int, int]",
    "(ii)d": "tuple[tuple[int, int], float]",
    "{s:i, s:O}": "dict[None | str, typing.Any]",
    "([i{sz}](s#y#){isfs})": (
        "tuple[list[dict[None | str, None | str] | int], tuple[None | str, None | bytes], dict[float | int, None | str]]"
    ),
}


def test_value_formats(spark):
    df = spark.createDataFrame([(k,) for k in VALUE_GOLDEN], "f string")
    rows = df.select("f", formats.value_format_type("f").alias("r")).collect()
    assert {r["f"]: r["r"]["type"] for r in rows} == VALUE_GOLDEN
    assert all(r["r"]["error"] is None for r in rows)


def test_value_format_errors(spark):
    df = spark.createDataFrame([(k,) for k in ["(i", "i)", "{s}", "?", "[i)"]], "f string")
    assert all(r["r"]["error"] for r in df.select(formats.value_format_type("f").alias("r")).collect())


def test_value_format_object_arguments(spark):
    df = spark.createDataFrame([("[OO]", ["int | None", "str"])], "f string, a array<string>")
    assert df.select(formats.value_format_type("f", "a").alias("r")).first()["r"]["type"] == "list[None | int | str]"


INVALID = ["q", "e", "w", "$i", "i||i", "()", "(i", "(())", "i)", "(i|i)", "[i]"]
VALID = ["is#|z*:ignored", "(i)(s#(O!y))", "", "O&;message"]


def test_positional_formats(spark):
    df = spark.createDataFrame([(k,) for k in INVALID + VALID], "f string")
    found = {r["f"]: r["e"] for r in df.select("f", formats.check_format("f").alias("e")).collect()}
    assert all(found[k] for k in INVALID)
    assert not any(found[k] for k in VALID)


@pytest.mark.parametrize(
    "fmt, names, good",
    [
        ("i|z$O", ["count", "label", "target"], True),
        ("i|$i$i", ["a", "b", "c"], False),
        ("i$i", ["a", "b"], False),
        ("i|$i|i", ["a", "b", "c"], False),
        ("i|i|i", ["a", "b", "c"], False),
        ("(i)", ["a"], False),
        ("ii", ["a"], False),
        ("ii", ["a", ""], False),
        ("i|i", ["", "b"], True),
        ("|$i", [""], False),
    ],
)
def test_keyword_formats(spark, fmt, names, good):
    df = spark.createDataFrame([(fmt, names)], "f string, n array<string>")
    error = df.select(formats.check_format("f", names="n").alias("e")).first()["e"]
    assert (error is None) == good


def slot(name, type=None, refined=None, default=None):
    return (name, type, refined, default)


def parsed(spark, fmt, slots, names=None):
    df = spark.createDataFrame([(fmt, slots, names)], f"f string, s array<{formats.SLOT}>, n array<string>")
    column = formats.parse_format_arguments("f", "s", None if names is None else "n")
    return df.select(column.alias("r")).first()["r"]


def test_arguments_of_positional_format(spark):
    r = parsed(spark, "is#|z*:ignored", [slot("a"), slot("b"), slot("n"), slot("v", default="None")])
    assert r["error"] is None
    assert [tuple(a) for a in r["args"]] == [
        ("a", "int", None, "POSITIONAL_ONLY"),
        ("b", "str | collections.abc.Buffer", None, "POSITIONAL_ONLY"),
        ("v", "str | collections.abc.Buffer | None", "None", "POSITIONAL_ONLY"),
    ]


def test_arguments_of_nested_format(spark):
    slots = [slot("a"), slot("b"), slot("n"), slot("t", type="list"), slot("o"), slot("y")]
    r = parsed(spark, "(i)(s#(O!y))", slots)
    assert [tuple(a) for a in r["args"]] == [
        ("a", "tuple[int,]", None, "POSITIONAL_ONLY"),
        ("b_o_y", "tuple[str | collections.abc.Buffer, tuple[list, collections.abc.Buffer]]", None, "POSITIONAL_ONLY"),
    ]
    r = parsed(spark, "|(ii)", [slot("a", default="1"), slot("b", default="2")])
    assert r["args"][0]["default_value"] == "(1, 2)"
    r = parsed(spark, "|(i)", [slot("a", default="1")])
    assert r["args"][0]["default_value"] == "(1,)"
    r = parsed(spark, "|(ii)", [slot("a", default="1"), slot("b")])
    assert r["args"][0]["default_value"] == "..."


def test_arguments_of_keyword_format(spark):
    slots = [slot("c"), slot("l", default="None"), slot("t", refined="str", default="...")]
    r = parsed(spark, "i|z$O", slots, ["count", "label", "target"])
    assert [tuple(a) for a in r["args"]] == [
        ("count", "int", None, "POSITIONAL_OR_KEYWORD"),
        ("label", "str | None", "None", "POSITIONAL_OR_KEYWORD"),
        ("target", "str", "...", "KEYWORD_ONLY"),
    ]
    r = parsed(spark, "O&|i", [slot("conv"), slot("x"), slot("y")], ["", "y"])
    assert [tuple(a) for a in r["args"]] == [
        ("x", "object", None, "POSITIONAL_ONLY"),
        ("y", "int", "...", "POSITIONAL_OR_KEYWORD"),
    ]


def overload(spark, value):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(signatures.parse_overload("t").alias("r")).first()["r"]


def test_overload_text(spark):
    r = overload(spark, "(x: int, y: str) -> str")
    assert [a["name"] for a in r["args"]] == ["x", "y"] and r["return_type"] == "str" and r["error"] is None
    r = overload(
        spark,
        '(a: int, /, x: tuple[int, int] = (1, 2), *, mapping: dict[str, int] = {"a": 1, "b": 2}, flag: str = "x") -> None',
    )
    assert [tuple(a) for a in r["args"]] == [
        ("a", "int", None, "POSITIONAL_ONLY"),
        ("x", "tuple[int, int]", "(1, 2)", "POSITIONAL_OR_KEYWORD"),
        ("mapping", "dict[str, int]", '{"a": 1, "b": 2}', "KEYWORD_ONLY"),
        ("flag", "str", '"x"', "KEYWORD_ONLY"),
    ]
    r = overload(spark, '(text: str = ") -> inside", value: tuple[int, int] = (1, 2)) -> str')
    assert [a["default_value"] for a in r["args"]] == ['") -> inside"', "(1, 2)"]
    r = overload(spark, "(self: X, *args, **kwargs) -> object")
    assert [a["kind"] for a in r["args"]] == ["POSITIONAL_OR_KEYWORD", "VAR_POSITIONAL", "VAR_KEYWORD"]
    assert overload(spark, "() -> None")["args"] == []


@pytest.mark.parametrize(
    "value",
    [
        "f(x: int) -> int\n\ndoc",
        "(x) -> int",
        "(x: int)",
        "(x: int) -> ",
        "(x: int = 1 = 2) -> int",
        "(x: ) -> int",
        "(x: list[int) -> int",
        "(x: int,, y: int) -> int",
        "(/, x: int) -> int",
        "(*, *, x: int) -> int",
        "(**kw, x: int) -> int",
        "(*a = 1) -> int",
        '(x: str = "open) -> int',
    ],
)
def test_overload_errors(spark, value):
    r = overload(spark, value)
    assert r["error"] and r["args"] is None


def delimited(spark, value):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(signatures.parse_delimited_signature("t").alias("r")).first()["r"]


def test_delimited_text(spark):
    r = delimited(spark, "short(Tensor input, *, MemoryFormat? memory_format=None)")
    assert [tuple(a) for a in r["args"]] == [
        ("input", "torch.Tensor", None, "POSITIONAL_OR_KEYWORD"),
        ("memory_format", "None | torch.memory_format", "None", "KEYWORD_ONLY"),
    ]
    assert delimited(spark, "demo(CustomType value)")["args"][0]["type"] == "CustomType"
    hidden = delimited(spark, "demo(int64_t value)|hidden")
    assert hidden["hidden"] and hidden["args"] is None and hidden["error"] is None
    assert delimited(spark, "demo(int64_t)")["error"]
    assert delimited(spark, "demo(int64_t a)|other")["error"]
    assert delimited(spark, "demo(IntArrayRef[2] k=1)")["args"][0]["type"] == "torch.types._size"
    assert delimited(spark, "demo()")["args"] == []


def test_name_specs(spark):
    df = spark.createDataFrame([("$out",), ("|axis",), ("|",), ("",), ("a",)], "s string")
    rows = [tuple(r["r"]) for r in df.select(signatures.parse_name_spec("s").alias("r")).collect()]
    assert rows == [
        ("out", "KEYWORD_ONLY", True),
        ("axis", "POSITIONAL_OR_KEYWORD", True),
        ("", "POSITIONAL_ONLY", True),
        ("", "POSITIONAL_ONLY", False),
        ("a", "POSITIONAL_OR_KEYWORD", False),
    ]


def test_name_triplets(spark):
    cases = [
        (["a", "conv", "s1", "|", None, "s2", None, None, None],),
        (["a", "conv"],),
        ([None, "c", "s"],),
        ([None, None, None, "a", "b", "c"],),
    ]
    df = spark.createDataFrame(cases, "v array<string>")
    rows = [r["r"] for r in df.select(signatures.parse_name_triplets("v").alias("r")).collect()]
    assert [i["name"] for i in rows[0]["items"]] == ["a", "s2"]
    assert rows[0]["error"] is None and all(r["error"] for r in rows[1:])


def test_unions(spark):
    df = spark.createDataFrame(
        [(["str", "int | typing.Any"],), (["str", "float | int", "bool", "int | bool", None],), ([],)], "m array<string>"
    )
    rows = [r["u"] for r in df.select(types.union_of_texts("m").alias("u")).collect()]
    assert rows == ["typing.Any", "bool | float | int | str", None]
    nested = spark.createDataFrame([(["dict[int | str, x]", "a | b"],)], "m array<string>")
    assert nested.select(types.union_of_texts("m").alias("u")).first()["u"] == "a | b | dict[int | str, x]"


def test_defaults(spark):
    cases = [
        ("null", True, "object", None, None, "..."),
        ("string", True, "str", "it's \"x\"\n", None, "'it\\'s \"x\"\\n'"),
        ("string", True, "str", "it's", None, "\"it's\""),
        ("float", False, "float", None, 1e-5, "1e-05"),
        ("float", False, "float", None, 1e16, "1e+16"),
        ("float", False, "float", None, 12345678.5, "12345678.5"),
        ("float", False, "float", None, 0.0005, "0.0005"),
        ("integer", False, "bool", None, 1.0, "True"),
        ("integer", False, "bool", None, 2.0, None),
        ("integer", False, "float", None, 3.0, "3.0"),
        ("integer", False, "int", None, -7.0, "-7"),
        ("unary", True, "object", "_Py_NoneStruct", None, "None"),
        ("unary", False, "int", "x", -1.0, "-1"),
        ("other", False, "int", None, 1.0, None),
    ]
    df = spark.createDataFrame(cases, "k string, p boolean, e string, t string, n double, want string")
    rows = df.select("want", text.render_default("k", "p", "e", "t", "n").alias("r")).collect()
    assert [r["r"]["default_value"] for r in rows] == [r["want"] for r in rows]
    assert all((r["want"] is None) == (r["r"]["error"] is not None) for r in rows)
