from pyspark.sql import functions as F

from apisurface import schemas as S
from apisurface.functions.text import doc_lines, slice_source
from apisurface.plans import evaluation as EV
from apisurface.plans import rendering as RN
from apisurface.streaming import counters as C


def test_module_text(spark):
    nodes = spark.createDataFrame(
        [
            ("m", None, "module", "pkg", "Doc of pkg.", None),
            ("s", "m", "module", "sub", None, None),
            ("c", "m", "class", "Box", None, ["base.Thing"]),
            ("e", "m", "class", "Empty", None, []),
            ("n", "c", "class", "Inner", None, None),
            ("k", "c", "function", "put", 'Say """hi"""\\', None),
            ("f", "m", "function", "load", None, None),
        ],
        S.NODES,
    )
    argument = S.ARGUMENT
    signatures = spark.createDataFrame(
        [
            ("k", 0, [("self", None, None, "POSITIONAL_OR_KEYWORD"), ("x", "int", "1", "KEYWORD_ONLY")], "None", [], "classmethod"),
            ("f", 0, [], "numpy.ndarray", ["numpy"], None),
            ("f", 1, [("a", "str", None, "POSITIONAL_ONLY")], "int", [], None),
        ],
        f"node_id string, signature_index int, args array<{argument}>, return_type string, imports array<string>, decorator string",
    )
    text = {}
    for row in RN.module_lines(nodes, signatures, include_docs=True).orderBy("module", "position").collect():
        text.setdefault(row["module"], []).append(row["line"])
    assert text["pkg"] == [
        '"""', "Doc of pkg.", '"""',
        "import numpy", "import typing",
        "from . import sub",
        "class Box(base.Thing):",
        "    class Inner:",
        "        pass",
        "    @classmethod",
        "    def put(",
        "        self,",
        "        *,",
        "        x: int = 1,",
        "    ) -> None:",
        '        """',
        '        Say \\"\\"\\"hi\\"\\"\\"\\\\',
        '        """',
        "class Empty:",
        "    pass",
        "@typing.overload",
        "def load() -> numpy.ndarray:",
        "    ...",
        "@typing.overload",
        "def load(a: str, /) -> int:",
        "    ...",
    ]
    assert "pkg.sub" not in text


def test_doc_lines_split_like_text_lines(spark):
    df = spark.createDataFrame([("a\r\nb\n\nc\n",), ("x",)], "d string")
    assert [r["l"] for r in df.select(doc_lines("d").alias("l")).collect()] == [
        ['"""', "a", "b", "", "c", '"""'], ['"""', "x", '"""'],
    ]


def test_slice_cuts_characters_and_rejects_negative(spark):
    df = spark.createDataFrame([(bytearray("a\u00e9\u20acb".encode()), 2, 5), (bytearray(b"abc"), 2, 1)], "d binary, s int, e int")
    rows = [r["r"] for r in df.select(slice_source("d", "s", "e").alias("r")).collect()]
    assert rows[0]["text"] == "" and rows[0]["error"] is None
    assert rows[1]["text"] is None and rows[1]["error"]


def functions(spark):
    base = ("m", None, "c_extension")
    rows = [
        ("m:a", *base, "success", "success", None, "src a", [(0, "def a():", None)]),
        ("m:b", *base, "failed", "failed", None, None, [(0, "def b():", None)]),
        ("m:c", *base, "failed", "success", None, None, [(0, "def c():", None), (1, "def c(x):", "raw")]),
    ]
    df = spark.createDataFrame(
        rows,
        "function_id string, module_name string, class_name string, provider string, parameter_inference_status string, "
        f"return_inference_status string, failure_reason string, source_text string, signatures array<{S.SIGNATURE}>",
    )
    return df.withColumns({"function_name": F.substring("function_id", 3, 9), "mapping_status": F.lit("success"), "source_location": F.lit(None).cast("string")})


def test_evaluation_flow(spark):
    references = spark.createDataFrame([("m", "", "a", 0, "def a(): ...", 3)], S.REFERENCE_SIGNATURES)
    pending, immediate = EV.prepare(EV.signature_entries(functions(spark)), references)
    assert [r["function_id"] for r in immediate.collect()] == ["m:b"]
    kinds = {(r["function_id"], r["signature_index"]): (r["reference_kind"], r["reference"]) for r in pending.collect()}
    assert kinds[("m:a", 0)] == ("manual_stub", '[{"signature":"def a(): ...","line":3}]')
    assert kinds[("m:c", 1)][0] == "signature_evidence" and '"raw_signature":"raw"' in kinds[("m:c", 1)][1]
    good = "{" + ", ".join(f'"{d}_code": "qualified", "{d}_reason": "r"' for d in S.DIMENSIONS) + "}"
    answers = spark.createDataFrame(
        [("m:a", 0, good, "t"), ("m:c", 0, good, "t"), ("m:c", 1, "no json", "t")],
        "function_id string, signature_index int, answer string, reasoning_content string",
    )
    rows = {(r["function_id"], r["signature_index"]): r for r in EV.evaluation_rows(pending, immediate, answers).collect()}
    assert rows[("m:a", 0)]["parameter_type_code"] == "qualified"
    assert rows[("m:c", 0)]["parameter_type_code"] == "rule_unqualified" and rows[("m:c", 0)]["return_type_code"] == "qualified"
    assert rows[("m:c", 1)]["status"] == "llm_error" and rows[("m:c", 1)]["return_type_code"] == "unqualified"
    assert rows[("m:b", 0)]["reference_kind"] == "inference_status"
    system, user = EV.messages(pending).first()["messages"]
    assert system["role"] == "system" and "inferred signature: def" in user["content"]


def test_missing_reference_fails(spark):
    import pytest

    bare = functions(spark).withColumns({"provider": F.lit(" "), "source_text": F.lit(None).cast("string")})
    pending, _ = EV.prepare(EV.signature_entries(bare))
    with pytest.raises(Exception, match="no reference for m:"):
        pending.collect()


def test_sampled_entries(spark):
    entries = EV.signature_entries(functions(spark), sample=2, seed=1)
    assert entries.count() == 2
    assert EV.signature_entries(functions(spark), sample=50).count() == 4


def test_stream_equals_batch_over_many_files(spark, tmp_path):
    rows = [(i, ["a", "b", "", None][i % 4], float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, provider string, ms double")
    df.repartition(8).write.parquet(str(tmp_path / "in"))
    stream = C.stream_results(spark, str(tmp_path / "in"), "id int, provider string, ms double", files_per_batch=3)
    C.run_available(C.stream_counters(stream), "t_counters", str(tmp_path / "c1"))
    got = {r["provider"]: r["functions"] for r in spark.table("t_counters").collect()}
    assert got == {"a": 100, "b": 100, "<unknown>": 200}
    C.run_available(C.stream_mean(stream, "ms"), "t_mean", str(tmp_path / "c2"))
    assert tuple(spark.table("t_mean").first()) == (400, 199.5)


def test_counters_by_batch_survive_a_restart(spark, tmp_path):
    import datetime

    source, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "id long, kind string, at timestamp, value double"
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, ["a", "b", None, ""][i % 4], start + datetime.timedelta(minutes=i), float(i % 7) if i % 5 else None) for i in range(60)]
    for part in range(6):
        own = rows[part * 10 : part * 10 + 10] + (rows[part * 10 - 3 : part * 10] if part else [])
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(source)

    def run(broken):
        stream = C.without_repeats(C.stream_results(spark, source, schema, files_per_batch=1), ["id"], "at")
        if broken:
            stream = stream.withColumn("value", F.when(F.col("id") == 34, F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
        C.write_partials(stream, path, state, ["kind"], value="value").awaitTermination()

    import pytest

    with pytest.raises(Exception, match="lost"):
        run(True)
    # What a batch that failed late may have left is replaced when it runs again.
    done = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "out").glob("batch=*"))
    spark.createDataFrame([("a", 99, 99, 9.0)], "kind string, functions long, completed long, total double").write.mode("overwrite").parquet(f"{path}/batch={max(done) + 1}")
    run(False)
    got = {r["kind"]: (r["functions"], r["completed"], r["mean"]) for r in C.read_totals(spark, path, ["kind"]).collect()}
    want = {}
    for _, kind, _, value in rows:
        want.setdefault(kind or "<unknown>", []).append(value)
    assert got == {k: (len(v), len([x for x in v if x is not None]), sum(x for x in v if x is not None) / len([x for x in v if x is not None])) for k, v in want.items()}
