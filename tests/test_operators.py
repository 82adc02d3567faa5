import bisect
import math
import random

import pytest
from pyspark.sql import functions as F

from apisurface.operators import aggregates as A
from apisurface.operators import filters as FL
from apisurface.operators import joins as J
from apisurface.operators import ordering as O
from apisurface.operators import projections as P
from apisurface.operators import sets as ST
from apisurface.operators import versions as V
from apisurface.operators import windows as W
from apisurface import skew
from apisurface.skew import running_sums


def skewed(n, seed=1):
    """Rows of which a third share one key; some keys are null."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        pick = rng.random()
        key = "hot" if pick < 0.34 else None if pick < 0.38 else f"k{rng.randrange(60)}"
        rows.append((i, key, rng.randrange(2000), round(rng.uniform(-50, 500), 2)))
    return rows


@pytest.fixture(scope="module")
def rows():
    return skewed(4000)


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id bigint, key string, pos int, value double").repartition(6)


def test_running_sums_equal_brute_force(table, rows, fine_buckets):
    got = running_sums(
        table, ["key"], ["pos", "id"], {"upto": (F.col("value"), True), "before": (F.lit(1), False)}
    ).collect()
    groups = {}
    for i, key, pos, value in rows:
        groups.setdefault(key, []).append((pos, i, value))
    want = {}
    for members in groups.values():
        total = 0.0
        for n, (_, i, value) in enumerate(sorted(members)):
            total += value
            want[i] = (round(total, 6), n)
    assert len(got) == len(rows)
    assert {r["id"]: (round(r["upto"], 6), r["before"]) for r in got} == want


@pytest.fixture
def fine_buckets(monkeypatch):
    """Parts of a few rows, so that small tables take the path of large ones."""
    monkeypatch.setattr(skew, "PART_ROWS", 50)


CASES = {
    "double": [None, float("-inf"), -1e9, -3.5, -1e-12, 0.0, 1e-300, 0.5, 7.0, 7.1, 1e18, float("inf"), float("nan")],
    "bigint": [None, -5, 0, 3, 1_000_000, 1_000_001, 1_000_002, 9_000_000_000],
    "string": [None, "prefix#0001", "prefix#0002", "prefix#0191", "prefix#9", "prefix#\u00e9", "prefix#a"],
    "date": [None, "1969-12-31", "1970-01-01", "2024-02-29", "2024-03-01"],
    "timestamp": [None, "1969-12-31 23:59:59", "2024-01-01 00:00:00", "2024-01-01 00:00:01", "2024-06-01 12:00:00"],
    "timestamp_ntz": [None, "1969-12-31 23:59:59", "2024-01-01 00:00:00", "2024-01-01 00:00:01", "2024-06-01 12:00:00"],
}


@pytest.mark.parametrize("kind", CASES)
def test_parts_keep_the_order(spark, kind, monkeypatch):
    monkeypatch.setattr(skew, "PART_ROWS", 2)
    raw = "string" if kind in ("date", "timestamp", "timestamp_ntz") else kind
    df = spark.createDataFrame([(v,) for v in CASES[kind]], f"v {raw}").select(F.col("v").cast(kind).alias("v"))
    cut = running_sums(df, [], ["v"], {"n": (F.lit(1), True)})
    assert [r["n"] for r in cut.orderBy("v").collect()] == list(range(1, len(CASES[kind]) + 1))


OUTLIERS = {
    "text": ("concat('https://host.example/a/', lpad(id, 9, '0'))", "SELECT 'abc' AS v UNION ALL SELECT ''"),
    "number": ("id + 1e9", "SELECT -1e300D AS v UNION ALL SELECT double('Infinity')"),
    "time": ("timestamp_seconds(1600000000 + id * 37)", "SELECT TIMESTAMP '9999-12-31' AS v UNION ALL SELECT TIMESTAMP '0001-01-01'"),
}


@pytest.mark.parametrize("kind", OUTLIERS)
def test_outliers_and_equal_values_leave_the_parts_even(spark, kind, monkeypatch):
    monkeypatch.setattr(skew, "PART_ROWS", 500)
    value, far = OUTLIERS[kind]
    df = spark.range(4000).selectExpr(f"{value} AS v").unionByName(spark.sql(far))
    same = df.limit(1).crossJoin(spark.range(2000)).select("v")
    for rows in (df, df.unionByName(same)):
        parts = skew._parts(rows, [], ["v"], None)
        sizes = [r["count"] for r in parts.groupBy("_part").count().collect()]
        assert max(sizes) <= 500 and sum(sizes) == rows.count()


def test_percentiles_of_outliers_ties_and_odd_numbers(spark, monkeypatch):
    rng = random.Random(4)
    values = [rng.choice([5.0, rng.gauss(0, 1), 1e300, -1e300]) for _ in range(6000)] + [float("nan")] * 40 + [float("inf"), None, None]
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(values)], "v double, g int").repartition(5)
    order = lambda v: (v != v, v)
    quantiles = {"low": 0.0, "a": 0.003, "mid": 0.5, "high": 0.997, "top": 1.0}
    for bracket, items in ((A.BRACKET, A.SKETCH_ITEMS), (0.0021, 8)):
        monkeypatch.setattr(A, "BRACKET", bracket)
        monkeypatch.setattr(A, "SKETCH_ITEMS", items)
        for row in A.floor_percentiles(df, "v", quantiles, ["g"]).collect():
            mine = sorted((v for i, v in enumerate(values) if i % 3 == row["g"] and v is not None), key=order)
            for name, q in quantiles.items():
                want = mine[int((len(mine) - 1) * q)]
                assert row[name] == want or (row[name] != row[name] and want != want)


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.9, 0.95, 1.0])
def test_floor_percentile_equals_brute_force(table, rows, q, fine_buckets):
    got = {r["key"]: r["p"] for r in A.floor_percentiles(table, "value", {"p": q}, ["key"]).collect()}
    groups = {}
    for _, key, _, value in rows:
        groups.setdefault(key, []).append(value)
    assert got == {k: sorted(v)[int((len(v) - 1) * q)] for k, v in groups.items()}


def test_floor_percentile_is_not_the_ceiling_rank(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (9.0,)], "v double")
    assert A.floor_percentiles(df, "v", {"p": 0.9}).first()["p"] == 3.0


def test_timing_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "v double, lib string")
    row = A.timing_summary(empty, "v").first()
    assert (row["functions"], row["total"], row["p90"]) == (0, 0.0, 0.0)
    with pytest.raises(Exception, match="no rows to summarize"):
        A.timing_summary(empty, "v", empty="error").collect()


def test_ecdf_marks_the_quantile(table, rows, fine_buckets):
    curve = W.ecdf(table, "value").orderBy("value").collect()
    values = sorted(r[3] for r in rows)
    assert [r["cumulative"] for r in curve] == [bisect.bisect_right(values, r["value"]) for r in curve]
    assert [r["value"] for r in curve if r["is_point"]] == [values[int((len(values) - 1) * 0.9)]]


def test_union_is_order_insensitive_and_idempotent(spark):
    types = ["int", "str | None", "dict[int | str, None]", "Never", "bool"]
    seen = set()
    for seed in range(4):
        random.Random(seed).shuffle(types)
        df = spark.createDataFrame([("f", t) for t in types + types], "fn string, t string")
        text = A.union_types(df, ["fn"], "t").first()["type"]
        again = spark.createDataFrame([("f", text)], "fn string, t string")
        assert A.union_types(again, ["fn"], "t").first()["type"] == text
        seen.add(text)
    assert seen == {"None | bool | dict[int | str, None] | int | str"}


def test_union_of_nothing_is_any_and_failed(spark):
    df = spark.createDataFrame([("f", "Never"), ("g", None), ("h", "None"), ("h", "int")], "fn string, t string")
    got = {r["fn"]: (r["type"], r["status"]) for r in A.union_types(df, ["fn"], "t", drop_none=True).collect()}
    assert got == {"f": ("typing.Any", "failed"), "g": ("typing.Any", "failed"), "h": ("int", "success")}


def test_last_definition_cases(spark):
    uses = spark.createDataFrame([("f1", "r", 10), ("f2", "r", 10), ("f3", "r", 10), ("f4", "r", 10), ("f5", "r", 3)], "fn string, var string, pos int")
    defs = spark.createDataFrame(
        [
            ("f1", "r", -1, "null", ""), ("f1", "r", 3, "call", "int"), ("f1", "r", 5, "call", "float"), ("f1", "r", 12, "call", "late"),
            ("f2", "r", 3, "call", "int"), ("f2", "r", 5, "null", ""),
            ("f3", "r", 3, "call", "int"), ("f3", "r", 5, "binary", "+"),
            ("f5", "r", 3, "call", "same place"),
        ],
        "fn string, var string, pos int, rhs_kind string, rhs_name string",
    )
    found = W.last_definition(
        uses, defs, ["fn", "var"], ["pos"], ["rhs_kind", "rhs_name"],
        ignored=F.col("rhs_kind") == "binary", is_null=F.col("rhs_kind") == "null",
    )
    got = {r["fn"]: (r["rhs_name"], r["usable"]) for r in found.collect()}
    assert got == {"f1": ("float", True), "f2": ("", False), "f3": ("int", True), "f4": (None, False), "f5": (None, False)}


def test_last_definition_on_a_hot_variable(spark, rows, fine_buckets):
    uses = spark.createDataFrame([(k, p, i) for i, k, p, _ in rows if i % 2], "key string, pos int, id bigint")
    defs = spark.createDataFrame([(k, p, i, v) for i, k, p, v in rows if not i % 2], "key string, pos int, id bigint, value double")
    found = W.last_definition(uses, defs, ["key"], ["pos", "id"], ["value"]).collect()
    groups = {}
    for i, key, pos, value in rows:
        groups.setdefault(key, []).append((pos, i, value))
    want = {}
    for members in groups.values():
        last = None
        for _, i, value in sorted(members):
            if i % 2:
                want[i] = last
            else:
                last = value
    assert {r["id"]: r["value"] for r in found} == want


def test_ranges_innermost_open_and_missing(spark):
    rng = random.Random(5)
    ranges = [("a", 0, 10_000_000, "unit")]
    for n in range(300):
        low = rng.randrange(0, 9_000_000)
        ranges.append((rng.choice("ab"), low, low + rng.choice([1, 16, 300, 70_000, 900_000]), f"f{n}"))
    ranges += [("b", 5_000_000, None, "tail"), ("a", 7, 7, "empty"), ("b", 400, None, "outer"), ("b", 9_500_000, None, "end")]
    points = [(i, rng.choice("abc"), rng.randrange(0, 12_000_000)) for i in range(1500)]
    points += [(10_000 + i, "a", 42) for i in range(900)]
    got = J.locate_ranges(
        spark.createDataFrame(points, "id int, lib string, at bigint"),
        spark.createDataFrame(ranges, "lib string, low_pc bigint, high_pc bigint, name string"),
        ["lib"], "at", ["id"],
    ).collect()

    def owner(lib, at):
        found = [
            ((2**62 if high is None else high - low), -low if high is None else low, name)
            for group, low, high, name in ranges
            if group == lib and low <= at and (high is None or at < high)
        ]
        return min(found)[2] if found else None

    assert len(got) == len(points)
    assert {r["id"]: r["name"] for r in got} == {i: owner(lib, at) for i, lib, at in points}
    assert all((r["name"] is None) == (r["error"] is not None) for r in got)


def test_rules_hit_miss_default_and_computed(spark):
    rules = spark.createDataFrame([("PyLong_FromLong", "int"), ("wrap", None)], "name string, type string")
    df = spark.createDataFrame([("PyLong_FromLong", "x"), ("other", "y"), ("wrap", "z")], "name string, arg string")
    got = J.apply_rules(df, rules, "name", F.lit("object"), computed={"wrap": F.upper("arg")}).collect()
    assert {r["name"]: r["rule_type"] for r in got} == {"PyLong_FromLong": "int", "other": "object", "wrap": "Z"}


def test_later_pack_wins(spark):
    a = spark.createDataFrame([("call", "f", "int", 0), ("call", "g", "str", 0)], "category string, name string, type string, priority int")
    b = spark.createDataFrame([("call", "f", "float", 1), ("object", "f", "x", 1)], "category string, name string, type string, priority int")
    got = {(r["category"], r["name"]): r["type"] for r in J.merge_rules([a, b]).collect()}
    assert got == {("call", "f"): "float", ("call", "g"): "str", ("object", "f"): "x"}


def test_default_rule_packs(spark):
    from apisurface.functions.rule_packs import default_packs

    merged = J.merge_rules(default_packs(spark))
    found = {(r["category"], r["name"]): (r["type"], r["imports"]) for r in merged.collect()}
    assert found[("call", "PyLong_FromLong")] == ("int", [])
    assert found[("call", "THPVariable_WrapWithType")] == ("None | torch.Tensor", ["torch"])
    assert found[("converter", "PyArray_IntpConverter")][1] == ["collections.abc", "typing"]
    assert found[("type_object", "Imaging_Type")] == ("PIL.Image.core.ImagingCore", ["PIL.Image"])
    assert found[("call", "PyErr_NoMemory")][0] == "Never"
    assert found[("converter", "trimmode_converter")][1] == ["typing"]


def test_linkage_name_does_not_fall_back(spark):
    df = spark.createDataFrame([(1, "_Zf", "f"), (2, "_Zmissing", "f"), (3, None, "f")], "id int, linkage_name string, function_name string")
    by_linkage = spark.createDataFrame([("_Zf", "d1")], "linkage_name string, definition string")
    by_name = spark.createDataFrame([("f", "d2")], "function_name string, definition string")
    got = {r["id"]: r["definition"] for r in J.join_by_identity(df, by_linkage, by_name).collect()}
    assert got == {1: "d1", 2: None, 3: "d2"}


def test_failure_counts_and_unsupported_does_not(spark):
    df = spark.createDataFrame(
        [("ok", None), ("unsupported", "ok"), ("unsupported", None), (None, None), ("partial", "ok"), ("error", None), (None, "error")],
        "c_outcome string, pybind_outcome string",
    ).withColumns({"c_reason": F.lit("c"), "pybind_reason": F.lit("p")})
    done = J.complete_with_fallback(df)
    assert tuple(A.completion_summary(done).first()) == (5, 1, 1, 3)
    partial = done.where("c_outcome = 'partial'").first()
    assert (partial["provider"], partial["mapping_status"], partial["use_minimal"]) == ("c_extension", "success", True)
    none = A.completion_summary(done.where("outcome = 'unsupported'")).first()
    assert tuple(none) == (0, 0, 0, 0)


def test_funnel_without_mapped_rows(spark):
    df = spark.createDataFrame([("failed", "success", "success")], "mapping_status string, parameter_inference_status string, return_inference_status string")
    row = A.funnel(df).first()
    assert row["mapping_rate"] == 0.0 and row["parameter_rate"] is None and row["parameter_success"] == 0
    assert A.funnel(df.limit(0)).first()["mapping_rate"] is None


def test_strict_domain_names_the_row(spark):
    df = spark.createDataFrame([("a", "ok"), ("b", "llm_error")], "function_id string, status string")
    assert FL.check_domain(df.limit(1), {"status": ["ok"]}, ["function_id"]).count() == 1
    with pytest.raises(Exception, match="illegal status: llm_error at function_id=b"):
        FL.check_domain(df, {"status": ["ok"]}, ["function_id"]).collect()


def test_strict_suffix(spark):
    df = spark.createDataFrame([("f(int a)",), ("f(int a)|hidden",), ("f(int a)|odd",)], "s string")
    with pytest.raises(Exception, match="unknown signature suffix: odd"):
        FL.drop_hidden(df, "s").collect()
    assert FL.drop_hidden(df.limit(2), "s").count() == 1


def test_bases_stop_at_the_marker(spark):
    df = spark.createDataFrame([(["a.B", "object", "pybind11_builtins.pybind11_object", "c.D"],), (["object"],)], "bases array<string>")
    assert [r["bases"] for r in FL.bases_until(df, "bases", "pybind11_builtins").collect()] == [["a.B"], []]


def test_call_flags_and_receiver(spark):
    df = spark.createDataFrame([(4,), (8,), (128,), (3,), (1,), (0,), (2,)], "flags int")
    got = {r["flags"]: ([a["name"] for a in r["args"][0]], r["parameter_inference_status"]) for r in P.decode_call_flags(df, "flags").collect()}
    assert got[4] == ([], "success") and got[8] == (["arg"], "success")
    assert got[128] == (["args"], "failed") and got[3] == (["args", "kwargs"], "failed") and got[0] == ([], "failed")
    single = P.decode_call_flags(spark.createDataFrame([(8,), (8 + 16,), (8 + 32,)], "flags int"), "flags")
    with_receiver = P.add_receiver(single.withColumn("a", F.col("args")[0]), "a", F.lit(True), "flags")
    assert [[(x["name"], x["kind"]) for x in r["a"]] for r in with_receiver.collect()] == [
        [("self", "POSITIONAL_ONLY"), ("arg", "POSITIONAL_ONLY")],
        [("cls", "POSITIONAL_ONLY"), ("arg", "POSITIONAL_ONLY")],
        [("arg", "POSITIONAL_ONLY")],
    ]


def test_tree_order_and_cycle(spark):
    nodes = [("m", None, "module", "m"), ("c", "m", "class", "B"), ("f", "m", "function", "z"), ("g", "c", "function", "a"), ("d", "c", "class", "A"), ("x", "y", "function", "lost")]
    nodes += [(f"h{i}", "c", "function", f"n{i:03d}") for i in range(200)]
    df = spark.createDataFrame(nodes, "node_id string, parent_id string, kind string, name string")
    flat = P.flatten_tree(df, kind="kind")
    ordered = [r["path"] for r in flat.orderBy("sort_path").collect()]
    assert ordered[:3] == ["m", "m.z", "m.B"] and ordered[-1] == "m.B.A" and len(ordered) == len(nodes) - 1


def test_reachable_with_cycles(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")] + [("b", f"n{i}") for i in range(300)] + [(f"n{i}", "c") for i in range(300)]
    df = spark.createDataFrame(edges, "src string, dst string")
    roots = spark.createDataFrame([("a",)], "node string")
    got = [r["node"] for r in ST.reachable(df, roots).collect()]
    assert sorted(got) == sorted({"a", "b", "c"} | {f"n{i}" for i in range(300)})


def test_sample_is_repeatable_and_whole_when_large(table):
    first = [r["id"] for r in O.sample_k(table, 20, 3, "id").collect()]
    assert first == sorted(first) and len(set(first)) == 20
    assert first == [r["id"] for r in O.sample_k(table.repartition(3), 20, 3, "id").collect()]
    assert first != [r["id"] for r in O.sample_k(table, 20, 4, "id").collect()]
    assert O.sample_k(table, 10_000, 3, "id").count() == table.count()


def test_diff_kinds(spark):
    a = spark.createDataFrame([("m:f", 0, "x"), ("m:g", 0, "y"), ("m:h", 0, None)], "function_id string, signature_index int, signature string")
    b = spark.createDataFrame([("m:f", 0, "x2"), ("m:h", 0, None), ("m:k", 1, "z")], "function_id string, signature_index int, signature string")
    got = {r["function_id"]: r["change"] for r in V.diff_catalogs(a, b).collect()}
    assert got == {"m:f": "changed", "m:g": "removed", "m:h": "unchanged", "m:k": "added"}


def test_evidence_is_null_when_all_is_blank(spark):
    df = spark.createDataFrame([("p", " ", None), ("", None, "  ")], "provider string, source_location string, source_text string")
    got = [r["evidence"] for r in P.with_evidence(df, ["provider", "source_location", "source_text"]).collect()]
    assert got == ['{"provider":"p"}', None]


def test_infinite_values_do_not_break_percentiles(spark):
    df = spark.createDataFrame([(math.inf,), (-math.inf,), (0.0,), (1.0,), (1.0,)], "v double")
    row = A.floor_percentiles(df, "v", {"lo": 0.0, "mid": 0.5, "hi": 1.0}).first()
    assert (row["lo"], row["mid"], row["hi"]) == (-math.inf, 1.0, math.inf)


def test_long_chains_branches_and_cycles_are_reached(spark, monkeypatch):
    monkeypatch.setattr(ST, "PLAIN_ROUNDS", 2)
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(150, 1000), (1000, 1001), (1001, 1000), (400, 401), (5, 900), (901, 902)]
    edges += [(1100 + i, 1101 + i) for i in range(40)] + [(280, 1100), (1140, 1100)] + [(rng.randrange(2000, 2050), rng.randrange(2000, 2050)) for _ in range(60)]
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    want, todo = set(), [3, 2001, 7777]
    while todo:
        node = todo.pop()
        if node not in want:
            want.add(node)
            todo += after.get(node, ())
    got = [r["node"] for r in ST.reachable(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(3,), (2001,), (7777,)], "node long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_deep_trees_cycles_and_orphans(spark):
    nodes = [(0, None, "n0")] + [(i, i - 1, f"n{i}") for i in range(1, 200)] + [(300, 301, "a"), (301, 300, "b"), (302, 300, "c"), (400, 999, "lost"), (401, 400, "too")]
    df = spark.createDataFrame(nodes, "node_id long, parent_id long, name string").repartition(3)
    got = {r["node_id"]: (r["path"], r["depth"]) for r in P.flatten_tree(df, orphans=True).collect()}
    want = {i: (".".join(f"n{k}" for k in range(i + 1)), i) for i in range(200)}
    assert got == want | {i: (None, None) for i in (300, 301, 302, 400, 401)}
    assert P.flatten_tree(df).count() == 200 and P.flatten_tree(df.limit(0)).collect() == []


def test_large_samples_equal_small_ones(spark, monkeypatch):
    df = spark.range(3000).repartition(4)
    for k in (0, 1, 137, 2999, 3000, 9999):
        small = [r["id"] for r in O.sample_k(df, k, 5, "id").collect()]
        monkeypatch.setattr(O, "LARGE_SAMPLE", -1)
        assert [r["id"] for r in O.sample_k(df, k, 5, "id").collect()] == small
        monkeypatch.setattr(O, "LARGE_SAMPLE", 10_000)
        assert len(small) == min(k, 3000)
    monkeypatch.setattr(O, "LARGE_SAMPLE", -1)
    assert [r["id"] for r in O.sample_k(df, 10, 5, "id", order=-F.col("id")).collect()] == list(range(2990, 3000))


def test_grouped_diff_equals_the_plain_one(spark):
    rng = random.Random(2)
    a = [(i, rng.choice(["m", "n", None, "o", "p"]), f"s{rng.randrange(3)}") for i in range(200)]
    b = [(i, "q" if i == 7 else m, "new" if m == "n" and i % 3 == 0 else s) for i, m, s in a if not (m == "o" and i % 5 == 0)] + [(1000, "r", "s"), (1001, None, "t")]
    one, two = (spark.createDataFrame(rows, "k int, m string, s string").repartition(3) for rows in (a, b))
    plain = V.diff_catalogs(one, two, ["k"], ["s"], ["m"])
    got = V.diff_grouped(one, two, "m", ["k"], ["s"]).select(*plain.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
