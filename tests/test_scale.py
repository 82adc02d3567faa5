"""What keeps the work of a query in proportion to its rows."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from apisurface.functions import formats
from apisurface.functions.rule_packs import rule_table
from apisurface.functions.signatures import parse_delimited_signature, parse_overload
from apisurface.functions.types import evaluate_once, split_top_level
from apisurface.operators import joins
from apisurface.operators.aggregates import floor_percentiles
from apisurface.operators.joins import merge_rules
from apisurface.operators.projections import flatten_tree
from apisurface.plans import completion, registry
from apisurface.sources import json_blocks, stubs, trees


def test_costly_column_is_not_evaluated_for_a_filter(spark):
    rows = spark.createDataFrame([("(a: int) -> str",)], "text string")
    parsed = evaluate_once(rows, "p", parse_overload("text")).where(F.col("p.error").isNull()).select("p.args")
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(a: int)") <= 1 and "size(array(" not in plan
    assert parsed.count() == 1


def test_large_tables_are_dealt_to_tasks_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(registry, "ROWS_A_TASK", 100)
    monkeypatch.setattr(registry, "SMALL_TABLE", 1000, raising=False)
    assert registry.spread(spark.range(5000, numPartitions=1)).rdd.getNumPartitions() == 50


def test_parts_of_nested_and_quoted_texts(spark):
    cases = {
        "a,b": (["a", "b"], None),
        "": ([""], None),
        "dict[int, str],{1: 'a,b'},x": (["dict[int, str]", "{1: 'a,b'}", "x"], None),
        "f(g(a,b),[c,{d,e}]),'\\',',h": (["f(g(a,b),[c,{d,e}])", "'\\','", "h"], None),
        "(a,b": (["(a,b"], "bracket is not closed"),
        "(a],b": (["(a],b"], "brackets do not match"),
        "a),b": (["a)", "b"], "brackets do not match"),
        "a,'b": (["a", "'b"], "unclosed string literal"),
        "(a,'b)": (["(a,'b)"], "unclosed string literal"),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "text string")
    told = rows.select("text", split_top_level("text", ",").alias("s")).collect()
    assert {r.text: (r.s.parts, r.s.error) for r in told} == cases


def test_delimited_text_odd_cases(spark):
    rows = spark.createDataFrame([(x,) for x in ("f(int a)", "f(int a|b", None, "f()", "f(*, int[2]? a=1)", "f(int)", "f(, )", "f(int a)|hidden", "f(int a)|x")], "text string")
    told = {r.text: r.p for r in evaluate_once(rows, "p", parse_delimited_signature("text")).collect()}
    assert [a.name for a in told["f(int a)"].args] == ["a"] and told["f()"].args == []
    assert [(a.type, a.default_value, a.kind) for a in told["f(*, int[2]? a=1)"].args] == [("None | int", "1", "KEYWORD_ONLY")]
    assert [told[x].error for x in ("f(int a|b", None, "f(int)", "f(, )", "f(int a)|x")] == [
        "not a delimited signature", "not a delimited signature", "parameter is malformed", "empty parameter", "unknown suffix: x",
    ]
    assert told["f(int a)|hidden"].hidden and told["f(int a)|hidden"].error is None


def test_a_block_of_a_document_takes_little_memory(tmp_path):
    entry = b'{"file": "a", "arguments": ["x", "{[\\""]},\n'
    data = b"[" + entry * (json_blocks.BLOCK // len(entry) + 1)
    (tmp_path / "c.json").write_bytes(data)
    blocks = pa.record_batch([pa.array([0], pa.int64())], ["block"])
    tracemalloc.start()
    sums = [r for b in json_blocks._sums(str(tmp_path / "c.json"), json_blocks.BLOCK)(iter([blocks])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(sums) == 1 and peak < 250 * 1024 * 1024


def test_document_is_written_by_ranges(spark, tmp_path):
    lines = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "a/x").otherwise("y").alias("path"), (-F.col("id")).alias("o"), F.concat(F.lit("l"), "id").alias("line"))
    assert trees.write_documents(lines.repartition(7), str(tmp_path), "path", ["o"], head="[", tail="]", between=",") == 2
    assert (tmp_path / "a/x").read_text() == "[" + ",".join(f"l{i}" for i in reversed(range(0, 5000, 3))) + "]"
    assert (tmp_path / "y").read_text() == "[" + ",".join(f"l{i}" for i in reversed(range(5000)) if i % 3) + "]"


def test_files_are_read_by_many_tasks(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"f{i}").write_text(str(i))
    found = trees.read_tree(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(int(bytes(r.content)) for r in found.collect()) == list(range(40))


def test_stub_lines_are_rows_not_tokens(spark):
    text = 'x = """a\nb ("""  # (\ndef f(\n    a, b,  # ):\n) -> int: ...\n\ny = 1 + \\\n  2\n@d\nclass A:\n\tdef g(self): ...\n'
    rows = sorted((r.row, r.line, r.statement) for r in stubs.stub_lines(spark.createDataFrame([("m", text)], "file string, text string")).collect())
    assert rows == [(0, 1, 0), (1, 3, 1), (2, 4, 1), (3, 5, 1), (4, 6, 2), (5, 7, 3), (6, 9, 4), (7, 10, 5), (8, 11, 6), (9, 12, 7)]
    got = sorted(tuple(r)[1:] for r in stubs.stub_functions(spark.createDataFrame([("m", text)], "file string, text string")).collect())
    assert got == [("", "f", "def f(a, b) -> int: ...", 3), ("A", "g", "def g(self): ...", 11)]


def test_paths_carry_names_alone(spark):
    nodes = spark.createDataFrame([(1, None, None, "module"), (2, 1, "b", "class"), (3, 2, "c", "function"), (4, None, "r", "module")], "node_id int, parent_id int, name string, kind string")
    got = {r.node_id: (r.path, r.depth, [tuple(s) for s in r.sort_path]) for r in flatten_tree(nodes, kind="kind").collect()}
    assert got == {1: (None, 0, [(3, None)]), 2: ("b", 1, [(3, None), (2, "b")]), 3: ("b.c", 2, [(3, None), (2, "b"), (1, "c")]), 4: ("r", 0, [(3, "r")])}
    plan = flatten_tree(nodes).select("path")._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_path" not in plan


def test_rows_of_a_large_group_stay_spread(spark, monkeypatch):
    from apisurface.operators import aggregates

    seen = []
    real = aggregates._in_brackets
    monkeypatch.setattr(aggregates, "_in_brackets", lambda rows, brackets: (seen.append(real(rows, brackets)), seen[-1])[1])
    rows = spark.range(20000).select(F.lit("a").alias("g"), (F.col("id") * 7919 % 20000).alias("v"))
    assert floor_percentiles(rows, "v", {"p50": 0.5}, ["g"]).collect()[0].p50 == 9999
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan


def test_shuffles_of_stored_rows_go_at_once(spark):
    from apisurface.llm.frames import CLEANUP, stored

    before = spark.conf.get(CLEANUP)
    assert stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "x").count() == 7
    assert spark.conf.get(CLEANUP) == before


def test_rules_are_not_shuffled_with_the_slots(spark):
    rules = merge_rules([rule_table(spark)])
    slots = spark.range(10).select(
        F.col("id").alias("fn"), F.lit(0).alias("call_pos"), F.lit(0).alias("slot_index"), F.lit("v").alias("var"),
        F.when(F.col("id") % 2 == 0, F.lit("&PyList_Type")).alias("operand"), F.lit(None).cast("string").alias("default_value"),
    )
    functions = slots.select("fn", F.lit("m").alias("module_name"), F.lit(None).cast("string").alias("class_name"), F.lit("f").alias("function_name"), F.lit(1).alias("flags"))
    calls = slots.select("fn", "call_pos", F.lit("O!").alias("fmt"))
    checks = slots.select("fn", "var", F.lit("PyUnicode_Check").alias("call_name"))
    returns = slots.select("fn", F.lit(1).alias("pos"), F.lit("call").alias("expr_kind"), F.lit("PyLong_FromLong").alias("expr_name"))
    assigns = returns.limit(0).select("fn", F.lit("").alias("var"), "pos", F.col("expr_kind").alias("rhs_kind"), F.col("expr_name").alias("rhs_name"))
    done = completion.complete_functions(functions, calls, slots, checks, returns, assigns, rules)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "hashpartitioning(_type_object" not in plan and "hashpartitioning(_converter" not in plan


def test_keyword_formats_are_read_without_a_fold_over_arguments(spark):
    rows = spark.createDataFrame([("i|z$O", ["", "b", "c"], [("x", None, None, None)] * 3)], f"f string, n array<string>, s array<{formats.SLOT}>")
    parsed = rows.select(formats.parse_format_arguments("f", "s", "n").alias("p"))
    assert "slot_names" not in parsed._jdf.queryExecution().analyzed().toString()
    assert [(a.name, a.kind, a.default_value) for a in rows.select(formats.parse_format_arguments("f", "s", "n").alias("p")).first().p.args] == [
        ("x", "POSITIONAL_ONLY", None), ("b", "POSITIONAL_OR_KEYWORD", "..."), ("c", "KEYWORD_ONLY", "..."),
    ]


def test_points_are_ordered_only_where_a_group_has_open_ranges(spark, monkeypatch):
    asked = []
    real = joins.last_before
    monkeypatch.setattr(joins, "last_before", lambda df, *rest: asked.append(df) or real(df, *rest))
    points = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, None, 5)], "fn int, binary string, address long")
    text = "binary string, low_pc long, high_pc long, name string"
    closed = spark.createDataFrame([("a", 0, 10, "x"), ("b", 0, 10, "y")], text)
    found = joins.locate_ranges(points, closed, ["binary"], "address", ["fn"])
    assert not asked and {r.fn: r.name for r in found.collect()} == {1: "x", 2: "y", 3: None}
    opened = closed.unionByName(spark.createDataFrame([("b", 1, None, "z"), (None, 2, None, "n")], text))
    found = joins.locate_ranges(points, opened, ["binary"], "address", ["fn"])
    assert {r.fn: r.name for r in found.collect()} == {1: "x", 2: "y", 3: "n"}
    assert {r.binary for r in asked[0].where("_kind = 1").collect()} == {"b", None}


def test_plain_stub_texts_are_cut_into_statements(spark, monkeypatch):
    text = (
        '"""Docs (\n"""\n@a.b\n# (\n\n@c(\n  1, "x"\n)\nclass A(B[int]):\n    @overload\n    async def f(\n        self,  # it\'s\n        b: "C)"|None = -1,\n    ) -> dict[str,int]: ...\n'
        "    x: int = 3\n    @d\n    @e('\"', k = [ 2, (3 ,), ])\n    def g(self, *, t: tuple[int, ...] = (5,), **kw): ...\ndef h(x = not 1, y: r'a' = .5 , /) -> X.Y: return {\n 1: 2}\n"
    )
    deep = "def d(x=((((((((((1)))))))))) ): ...\nclass E:\n    def e(self, ): ...\n"
    files = spark.createDataFrame([("m", text), ("n", deep), ("o", "x = )\ndef p(): ..."), ("q", "@r\n# end"), ("s", None)], "file string, text string")
    whole = [
        ("m", "", "h", "def h(x=not 1, y: r'a'=.5, /) -> X.Y: ...", 19),
        ("m", "A", "f", "@overload\nasync def f(self, b: 'C)' | None=-1) -> dict[str, int]: ...", 11),
        ("m", "A", "g", "@d\n@e('\"', k=[2, (3,)])\ndef g(self, *, t: tuple[int, ...]=(5,), **kw): ...", 18),
    ]
    rest = [("n", "", "d", "def d(x=((((((((((1))))))))))): ...", 1), ("n", "E", "e", "def e(self,): ...", 3), ("o", "", "p", "def p(): ...", 2)]
    found = lambda df: sorted(tuple(r) for r in stubs.stub_functions(df).collect())
    assert found(files) == whole + rest
    heads = spark.createDataFrame([(s,) for s in ("a , b", "x : = 1", "* * x", "f( (1 ,), 'b' , )", "x = lambda y : 1", "( - 1, )", "[ a | - b ** c ]", "\"it's\" 'q\"' \"z\"")], "t string")
    spaced = heads.select("t", stubs.spaced_text(F.col("t")).alias("new"), stubs.spaced_tokens(stubs._tokens(F.col("t"))).alias("old")).collect()
    assert [r.new for r in spaced] == [r.old for r in spaced]
    # Lines are made of texts alone whose brackets are deep or do not match.
    seen = []
    real = stubs.stub_lines
    monkeypatch.setattr(stubs, "stub_lines", lambda df, *a: (seen.append(df.count()), real(df, *a))[1])
    assert found(files.where("file = 'm'")) == whole and not seen
    assert found(files.where("file <> 's'")) == whole + rest and seen == [2]


def test_lines_of_a_module_go_to_its_file_as_rows(spark, tmp_path, monkeypatch):
    from apisurface.sources import writers

    plans = []
    real = trees.in_arrow
    monkeypatch.setattr(trees, "in_arrow", lambda df, *a: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df, *a))[1])
    rows = [("a.b", i, f"l{i % 7}\né" if i % 5 else None, i == 40) for i in range(60)] + [("a.c", 2, "y", None), ("a.c", 1, "z", None), ("a.c", 1, "x", None), ("d", 0, None, False)]
    lines = spark.createDataFrame(rows, "module string, position int, line string, package boolean").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert writers.write_module_files(lines, str(tmp_path), F.col("package")) == 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file() and not p.name.endswith(".crc")}
    assert got == {"a/b/__init__.pyi": "".join(f"l{i % 7}\né\n" for i in range(60) if i % 5), "a/c.pyi": "x\nz\ny\n", "d.pyi": "\n"}
    assert plans and not any("collect_list" in p for p in plans)
