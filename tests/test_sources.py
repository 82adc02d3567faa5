import json

import pytest
from pyspark.sql import functions as F

from apisurface.sources import readers as RD
from apisurface.sources import writers as WR

RECORD = {
    "function_id": "m:f", "module_name": "m", "function_name": "f", "provider": "c_extension",
    "mapping_status": "success", "parameter_inference_status": "success", "return_inference_status": "failed",
    "failure_reason": "  ", "signatures": [{"signature_index": 0, "signature": "def f():", "raw_signature": " raw "}],
}


def test_function_records_from_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(RECORD) + "\n")
    (tmp_path / "b.json").write_text(json.dumps({"functions": [RECORD, {**RECORD, "function_id": "m:g"}]}, indent=1))
    for path, kind, n in (("a.json", "json", 1), ("b.json", "json_document", 2)):
        rows = RD.read_function_records(spark, str(tmp_path / path), kind).collect()
        assert len(rows) == n and rows[0]["function_id"] == "m:f"
        assert rows[0]["failure_reason"] is None and rows[0]["class_name"] is None
        assert rows[0]["signatures"][0]["raw_signature"] == "raw"


def test_function_records_are_checked(spark, tmp_path):
    (tmp_path / "blank.json").write_text(json.dumps({**RECORD, "provider": " "}))
    with pytest.raises(Exception, match="provider is missing or blank in m:f"):
        RD.read_function_records(spark, str(tmp_path / "blank.json")).collect()
    (tmp_path / "none.json").write_text(json.dumps({k: v for k, v in RECORD.items() if k != "signatures"}))
    with pytest.raises(Exception, match="signatures are missing"):
        RD.read_function_records(spark, str(tmp_path / "none.json")).collect()


HEADER = "function_id,elapsed_ns,elapsed_ms,provider,mapping_status,parameter_inference_status,return_inference_status,signature_count,failure_reason"


def test_measurements_of_several_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "\nm:f,1500000,1.5,,success,success,failed,2,\n")
    swapped = HEADER.replace("function_id,elapsed_ns", "elapsed_ns,function_id") + ",extra"
    (tmp_path / "b.csv").write_text(swapped + '\n7,m:g,0.000007,pybind11,success,success,success,1,"bad, ""x""",e\n')
    rows = {r["function_id"]: r for r in RD.read_measurements(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()}
    assert rows["m:f"]["provider"] is None and rows["m:f"]["failure_reason"] is None and rows["m:f"]["elapsed_ns"] == 1500000
    assert rows["m:g"]["failure_reason"] == 'bad, "x"' and rows["m:g"]["source_csv"].endswith("b.csv")
    (tmp_path / "c.csv").write_text("function_id,elapsed_ns\nm:f,1\n")
    with pytest.raises(ValueError, match="lacks columns: elapsed_ms, failure_reason"):
        RD.read_measurements(spark, str(tmp_path / "c.csv"))


def test_measurements_are_written_slowest_first(spark, tmp_path):
    rows = [(f"m:{i}", (i * 37) % 101) for i in range(101)]
    df = spark.createDataFrame(rows, "function_id string, elapsed_ns bigint").repartition(5)
    WR.write_measurements(df, str(tmp_path / "out"))
    written = []
    for part in sorted((tmp_path / "out").glob("part-*")):
        written += [int(line.split(",")[1]) for line in part.read_text().splitlines()[1:]]
    assert written == sorted(written, reverse=True) and len(written) == 101


def test_no_evaluations(spark):
    assert RD.read_evaluations(spark).count() == 0


def test_first_compile_command_wins(spark, tmp_path):
    path = tmp_path / "compile_commands.json"
    path.write_text(json.dumps([
        {"file": "a.c", "directory": "/src", "arguments": ["cc", "-c", "a.c"]},
        {"file": "/src/a.c", "directory": "/src", "arguments": ["other"]},
        {"file": "b.c", "directory": "/src", "command": "cc -O2 b.c"},
    ]))
    rows = {r["file"]: r["arguments"] for r in RD.read_compile_commands(spark, str(path)).collect()}
    assert rows == {"/src/a.c": ["cc", "-c", "a.c"], "/src/b.c": ["cc", "-O2", "b.c"]}
    with pytest.raises(ValueError, match="compile_commands.json"):
        RD.read_compile_commands(spark, str(tmp_path / "commands.json"))


def test_ranked_list_keeps_file_order(spark, tmp_path):
    path = tmp_path / "top.json"
    path.write_text(json.dumps({"rows": [{"project": p, "download_count": n} for p, n in (("z", 9), ("a", 8), ("m", 7))]}))
    assert [r["project"] for r in RD.read_ranked(spark, str(path), 2).orderBy("rank").collect()] == ["z", "a"]


def test_corpus_prunes_git_and_drops_bad_bytes(spark, tmp_path):
    (tmp_path / "r" / ".git").mkdir(parents=True)
    (tmp_path / "r" / ".git" / "x").write_text("hidden")
    (tmp_path / "r" / "deep").mkdir()
    (tmp_path / "r" / "deep" / "_core.c").write_text("PyInit__core")
    (tmp_path / "r" / "a.c").write_bytes(b"caf\xc3\xa9 \xff\xfe ok \xef\xbf\xbd \xe2\x82")
    rows = RD.read_source_corpus(spark, str(tmp_path / "r")).collect()
    assert sorted(r["text"] for r in rows) == ["PyInit__core", "caf\u00e9  ok \ufffd "]


def test_reference_stubs(spark, tmp_path):
    rows = [
        ("pkg/__init__.pyi", "pkg", "", "top", "def top(x: int=1) -> int: ...", 1),
        ("pkg/mod.pyi", "pkg.mod", "A.B", "f", "@typing.overload\nasync def f(self, a, *, b='x'): ...", 7),
        ("pkg/mod.pyi", "pkg.mod", "A.B", "f", "@typing.overload\ndef f(self) -> None: ...", 5),
    ]
    spark.createDataFrame(rows, RD.REFERENCES).write.json(str(tmp_path / "one"))
    got = RD.read_reference_stubs(spark, str(tmp_path / "one")).orderBy("module_name", "ordinal").collect()
    assert [tuple(r) for r in got] == [
        ("pkg", "", "top", 0, rows[0][4], 1), ("pkg.mod", "A.B", "f", 0, rows[2][4], 5), ("pkg.mod", "A.B", "f", 1, rows[1][4], 7)
    ]
    spark.createDataFrame([*rows, ("pkg.pyi", "pkg", "", "g", "def g(): ...", 1)], RD.REFERENCES).write.parquet(str(tmp_path / "two"))
    with pytest.raises(Exception, match="two stub files describe module pkg"):
        RD.read_reference_stubs(spark, str(tmp_path / "two"), "parquet").collect()


def test_records_need_signatures(spark, tmp_path):
    df = spark.createDataFrame([("m:f", [])], "function_id string, signatures array<struct<signature_index:int,signature:string,raw_signature:string>>")
    with pytest.raises(Exception, match="no signatures: m:f"):
        WR.write_function_records(df, str(tmp_path / "out"))


def test_module_texts_keep_line_order_over_part_files(spark, tmp_path):
    rows = [("big", i, f"line {i}") for i in range(500)] + [("small", 0, "only")]
    df = spark.createDataFrame(rows, "module string, position int, line string").orderBy(F.rand(1))
    WR.write_module_texts(df, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out" / "module=big").glob("part-*"))
    lines = [line for part in parts for line in part.read_text().splitlines()]
    assert lines == [f"line {i}" for i in range(500)]


def test_package_report(spark):
    df = spark.createDataFrame([("p", [("ctypes", ["CDLL("])]), ("q", None)], "name string, extensions array<struct<type:string,keywords:array<string>>>")
    assert [r["extensions"] for r in WR.package_rows(df).collect()] == ['[{"type":"ctypes","keywords":["CDLL("]}]', "[]"]
    flags = spark.createDataFrame([("b", False), ("c", True), ("a", True)], "module_name string, native boolean")
    assert [r["module_name"] for r in WR.native_modules(flags, "module_name", "native").collect()] == ["a", "c", "b"]


STUB = '''"""Doc with def f(x): ... and (
brackets"""
import typing
from typing import overload  # a comment (

def plain(a: int = 1, *args: str, b="x#y(", **kw: typing.Any) -> dict[str, int]: ...
async def go(x, /, y: int|None=None, *, z=-1) -> None: ...
@overload
def many(x: int) -> int: ...
@overload  # second
def many(
    x: str,   # text
    y: "list[int]" = ...,
) -> str:
    """Doc: def inner(): pass
def not_me(): ...
    """
    ...

class A(Base[int], metaclass=M):
    """Docs."""
    x: int = 3
    def m(self) -> int: ...
    class B:
        @staticmethod
        def n(a: float = 1.5, b: tuple[int, ...] = (1, 2)) -> typing.Self: ...

        def o(self, f: Callable[[int], str]=lambda v: v + 1): ...
    def p(self): ...
    if True:
        def hidden(self): ...
if sys.version_info >= (3, 8):
    def also_hidden(): ...
    class H:
        def q(self): ...
def last(x: int \\
    = 2) -> int: ...
@deco(1, "two", key=[3])
class C: ...
class D:
\tdef tabbed(self, *, k: 'str' = "it's"): ...
def t(x=(1,), y={'a': 1, "b": 2}, z=not True, w=a if b else c, v=2 ** 3 | ~x): ...
'''


def by_syntax_tree(body, path=()):
    """Functions of a stub text as Python's own parser sees them."""
    import ast

    for node in body:
        if isinstance(node, ast.ClassDef):
            yield from by_syntax_tree(node.body, (*path, node.name))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            head = ("async def" if isinstance(node, ast.AsyncFunctionDef) else "def") + f" {node.name}({ast.unparse(node.args)})"
            head += "" if node.returns is None else f" -> {ast.unparse(node.returns)}"
            yield ".".join(path), node.name, "\n".join([*(f"@{ast.unparse(d)}" for d in node.decorator_list), head + ": ..."]), node.lineno


def test_stub_texts_against_pythons_parser(spark):
    import ast

    from apisurface.sources.stubs import stub_functions

    texts = {"m.pyi": STUB, "e.pyi": "", "c.pyi": "# only a comment", "w.pyi": "def f(): ...\r\nclass X:\r\n  def g(self): ...\r\n", "one.pyi": "class P: ...\ndef q() -> 'P': ..."}
    files = spark.createDataFrame(list(texts.items()), "file string, text string").repartition(3)
    got = sorted(tuple(r) for r in stub_functions(files).collect())
    assert got == sorted((file, *row) for file, text in texts.items() for row in by_syntax_tree(ast.parse(text).body))
    assert stub_functions(files.limit(0)).collect() == []


def test_stub_files_of_a_tree(spark, tmp_path):
    root = tmp_path / "stubs"
    (root / "pkg" / "sub").mkdir(parents=True)
    (root / "pkg" / "__init__.pyi").write_text("def top(): ...\n")
    (root / "pkg" / "sub" / "mod.pyi").write_text("class A:\n    @overload\n    def f(self) -> int: ...\n    @overload\n    def f(self, x) -> str: ...\n")
    (root / "pkg" / "notes.txt").write_text("def no(): ...")
    got = sorted(tuple(r) for r in RD.read_reference_stubs(spark, str(root), "pyi").collect())
    assert got == [
        ("pkg", "", "top", 0, "def top(): ...", 1),
        ("pkg.sub.mod", "A", "f", 0, "@overload\ndef f(self) -> int: ...", 3),
        ("pkg.sub.mod", "A", "f", 1, "@overload\ndef f(self, x) -> str: ...", 5),
    ]
    (root / "pkg" / "sub" / "mod").mkdir()
    (root / "pkg" / "sub" / "mod" / "__init__.pyi").write_text("")
    with pytest.raises(Exception, match="two stub files describe module pkg.sub.mod"):
        RD.read_reference_stubs(spark, str(root), "pyi").collect()


def test_objects_of_a_document_cut_anywhere(spark, tmp_path):
    import random

    from apisurface.sources.json_blocks import json_objects

    rng = random.Random(1)

    def value():
        return "".join(rng.choice(["a", '"', "\\", "{", "}", "[", "]", "\u00e9", "\n", ",", ":"]) for _ in range(rng.randint(0, 12)))

    objects = [{"k": value(), "n": [{"x": value()}, [value()]], "i": i} for i in range(60)]
    plain, named = tmp_path / "a.json", tmp_path / "b.json"
    plain.write_text(json.dumps(objects, ensure_ascii=False, indent=1))
    named.write_text(json.dumps({"other": [{"z": 1}], "meta": {"rows": [1]}, "rows": objects, "last": [{"q": 2}]}, ensure_ascii=False))
    for block in (7, 64, 1 << 20):
        for path, field in ((plain, None), (named, "rows")):
            found = json_objects(spark, str(path), field, block).orderBy("pos").collect()
            assert [json.loads(r["text"]) for r in found] == objects
    with pytest.raises(ValueError, match="has no list of lines"):
        json_objects(spark, str(named), "lines")
    (tmp_path / "c.json").write_text('[{"a": 1}')
    with pytest.raises(ValueError, match="not a whole JSON document"):
        json_objects(spark, str(tmp_path / "c.json"))
    (tmp_path / "d.json").write_text("[]")
    assert json_objects(spark, str(tmp_path / "d.json")).collect() == []


def test_trees_are_listed_level_by_level(spark, tmp_path):
    from apisurface.sources.trees import list_tree, read_tree, write_tree

    rows = [(f"{'d/' * (i % 4)}f{i}.c", f"text {i}") for i in range(40)] + [(".git/x", "no"), ("d/.git/deep/y", "no"), ("_a/.b/__init__.pyi", "yes"), ("d/empty", None)]
    root = f"file://{tmp_path}/tree"
    assert write_tree(spark.createDataFrame(rows, "path string, content string").repartition(3), root) == len(rows)
    (tmp_path / "tree" / "d" / "round").symlink_to("round")
    (tmp_path / "tree" / "d" / "nowhere").symlink_to("missing")
    (tmp_path / "tree" / "hollow").mkdir()
    got = {r["relative_path"]: bytes(r["content"]).decode() for r in read_tree(spark, root).collect()}
    assert got == {p: t or "" for p, t in rows if ".git" not in p}
    assert {r["relative_path"] for r in read_tree(spark, root, ".pyi").collect()} == {"_a/.b/__init__.pyi"}
    assert list_tree(spark, str(tmp_path / "none")).collect() == []


def test_module_files(spark, tmp_path):
    rows = [("a", True, i, f"line {i}") for i in range(30)] + [("a.b", False, 0, "only")]
    df = spark.createDataFrame(rows, "module string, package boolean, position int, line string").orderBy(F.rand(1))
    assert WR.write_module_files(df, str(tmp_path / "out"), F.col("package")) == 2
    assert (tmp_path / "out" / "a" / "__init__.pyi").read_text() == "".join(f"line {i}\n" for i in range(30))
    assert (tmp_path / "out" / "a" / "b.pyi").read_text() == "only\n"
