"""Sources, sinks, projections and filters on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from apisurface import schemas as S
from apisurface.functions import text as X
from apisurface.operators import filters as FL
from apisurface.operators import projections as P
from apisurface.operators.aggregates import timing_summary, type_coverage
from apisurface.operators.joins import match_keywords
from apisurface.plans.registry import LINE_ORDER, LINE_ORDER_SQL, bound, ordered_lines, text
from apisurface.session import shared_folder
from apisurface.sources import readers as RD
from apisurface.sources import writers as WR

PAGE_KEYWORDS = {
    "<script": "script",
    "<nav": "layout",
    "<table": "layout",
    'class="ad"': "ad",
    "<article": "content",
}


def order_functions(t):
    """Orders as function records whose signatures are their lines."""
    signature = F.transform(
        "lines",
        lambda x, i: F.struct(
            i.cast("int").alias("signature_index"),
            F.concat(F.lit("def f("), x["l_partkey"].cast("string"), F.lit("): ...")).alias("signature"),
            F.when(x["l_returnflag"] == "A", F.lit("  ")).otherwise(x["l_returnflag"]).alias("raw_signature"),
        ),
    )
    orders = t.orders.join(ordered_lines(t, "l_returnflag"), F.col("o_orderkey") == F.col("l_orderkey"))
    good = F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed")
    return orders.select(
        F.concat("o_orderpriority", F.lit(":order_"), F.col("o_orderkey").cast("string")).alias("function_id"),
        F.col("o_orderpriority").alias("module_name"),
        F.lit(None).cast("string").alias("class_name"),
        F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("function_name"),
        F.lit(None).cast("string").alias("decorator"),
        F.concat(F.lit("provider_"), "o_orderstatus").alias("provider"),
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("success").alias("mapping_status"),
        good.alias("parameter_inference_status"),
        good.alias("return_inference_status"),
        F.when(F.col("o_orderstatus") == "P", F.lit(" pending ")).otherwise(F.lit("  ")).alias("failure_reason"),
        F.lit(None).cast("string").alias("source_location"),
        F.lit(None).cast("string").alias("source_text"),
        signature.alias("signatures"),
    )


@bound(
    "src1_read_function_records",
    f"""
    SELECT o_orderpriority || ':order_' || o_orderkey AS function_id, 'provider_' || o_orderstatus AS provider,
           CASE WHEN o_orderstatus = 'P' THEN 'pending' END AS failure_reason, n AS signature_count, sigs, raws
    FROM orders JOIN (
        SELECT l_orderkey, count(*) AS n,
               string_agg('def f(' || l_partkey || '): ...', '|' ORDER BY {LINE_ORDER_SQL}, l_returnflag) AS sigs,
               string_agg(CASE WHEN l_returnflag = 'A' THEN '-' ELSE l_returnflag END, '|'
                          ORDER BY {LINE_ORDER_SQL}, l_returnflag) AS raws
        FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
    """,
)
def src1(t):
    path = shared_folder(t.spark, "records")
    order_functions(t).write.json(path)
    records = RD.read_function_records(t.spark, path)
    return records.select(
        "function_id",
        "provider",
        "failure_reason",
        F.size("signatures").cast("bigint").alias("signature_count"),
        F.array_join(F.transform("signatures", lambda s: s["signature"]), "|").alias("sigs"),
        F.array_join(F.transform("signatures", lambda s: F.coalesce(s["raw_signature"], F.lit("-"))), "|").alias("raws"),
    )


def event_measurements(t):
    return t.events.select(
        F.concat(F.lit("m:f"), F.col("event_id").cast("string")).alias("function_id"),
        F.round(F.col("value") * 1000000).cast("bigint").alias("elapsed_ns"),
        F.col("value").alias("elapsed_ms"),
        F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("event_type")).alias("provider"),
        F.lit("success").alias("mapping_status"),
        F.lit("success").alias("parameter_inference_status"),
        F.lit("success").alias("return_inference_status"),
        F.lit(1).alias("signature_count"),
        F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.lit("")).alias("failure_reason"),
    )


_MEASURED_SQL = """
    SELECT 'm:f' || event_id AS function_id, CAST(round(value * 1000000) AS BIGINT) AS elapsed_ns, value AS elapsed_ms,
           CASE WHEN event_type <> 'error' THEN event_type END AS provider,
           CASE WHEN event_type = 'error' THEN props END AS failure_reason
    FROM events
"""


@bound("src2_read_measurements", _MEASURED_SQL)
def src2(t):
    path = shared_folder(t.spark, "measurements")
    event_measurements(t).write.csv(path, header=True, escape='"')
    return RD.read_measurements(t.spark, path).select(
        "function_id", "elapsed_ns", "elapsed_ms", "provider", "failure_reason"
    )


def label_evaluations(t):
    code = F.when(F.col("quality") == 1, F.lit("qualified")).otherwise(F.lit("unqualified"))
    toxic = F.when(F.col("toxic") == 1, F.lit("rule_unqualified")).otherwise(F.lit("qualified"))
    return t.labels.select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("function_id"),
        F.lit("doc").alias("module_name"),
        F.lit(None).cast("string").alias("class_name"),
        F.lit("f").alias("function_name"),
        F.lit(0).alias("signature_index"),
        F.lit('def f(x: str = "a,b"):\n    ...').alias("inferred_signature"),
        code.alias("parameter_structure_code"),
        F.lit("r1").alias("parameter_structure_reason"),
        toxic.alias("parameter_type_code"),
        F.lit("r2").alias("parameter_type_reason"),
        code.alias("return_type_code"),
        F.lit("r3").alias("return_type_reason"),
        F.lit("ok").alias("status"),
        F.lit(None).cast("string").alias("status_reason"),
        F.lit(None).cast("string").alias("reasoning_content"),
        F.lit("manual_stub").alias("reference_kind"),
        F.lit("[]").alias("reference"),
    )


@bound(
    "src3_read_evaluations",
    """
    SELECT 'doc:' || doc_id AS function_id, 'def f(x: str = "a,b"):' || chr(10) || '    ...' AS inferred_signature,
           CASE WHEN quality = 1 THEN 'qualified' ELSE 'unqualified' END AS parameter_structure_code,
           CASE WHEN toxic = 1 THEN 'rule_unqualified' ELSE 'qualified' END AS parameter_type_code
    FROM labels
    """,
)
def src3(t):
    path = shared_folder(t.spark, "evaluations")
    rows = label_evaluations(t)
    # Columns in another order than the schema has: they are found by their header.
    rows.select(*reversed(rows.columns)).write.csv(path, header=True, escape='"')
    return RD.read_evaluations(t.spark, path).select(
        "function_id", "inferred_signature", "parameter_structure_code", "parameter_type_code"
    )


@bound(
    "src4_first_compile_command",
    """
    SELECT user_id AS file, arg_min(event_type, event_id) AS directory, arg_min(props, event_id) AS arguments
    FROM events GROUP BY 1
    """,
)
def src4(t):
    commands = t.events.select(
        F.col("user_id").alias("file"),
        F.col("event_id").alias("pos"),
        F.col("event_type").alias("directory"),
        F.col("props").alias("arguments"),
    )
    return RD.first_commands(commands)


@bound("src5_first_ranked", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 1000")
def src5(t):
    from apisurface.operators.ordering import first_n

    return first_n(t.part.select("p_partkey", "p_name"), "p_partkey", 1000)


@bound(
    "src6_corpus_texts",
    "SELECT '/repo/x/' || page_id AS path, html AS text FROM pages WHERE url NOT LIKE '%/fr/%'",
)
def src6(t):
    folder = F.when(F.contains("url", F.lit("/fr/")), F.lit("/repo/.git/")).otherwise(F.lit("/repo/x/"))
    files = t.pages.select(
        F.concat(folder, F.col("page_id").cast("string")).alias("path"),
        # A stray continuation byte in front, which must vanish.
        F.concat(F.unhex(F.lit("80")), F.col("html").cast("binary")).alias("content"),
    )
    return RD.corpus_texts(files)


@bound(
    "src7_reference_stubs",
    """
    SELECT 'orders.' || l_orderkey AS module_name, 'Line' AS class_path, 'f' || l_linenumber AS function_name,
           (row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, t) - 1)::INTEGER AS ordinal,
           t AS text, l_partkey::INTEGER AS line
    FROM (SELECT *, 'def f' || l_linenumber || '(self, supplier: int = ' || l_suppkey || ', flag: ' || l_returnflag || ') -> float: ...' AS t
          FROM lineitem)
    """,
)
def src7(t):
    """Lines of an order that share a number are overloads of one function; the table goes through JSON lines."""
    path = shared_folder(t.spark, "references")
    module = F.concat(F.lit("orders."), F.col("l_orderkey").cast("string"))
    signature = F.concat(
        F.lit("def f"), F.col("l_linenumber").cast("string"), F.lit("(self, supplier: int = "), F.col("l_suppkey").cast("string"),
        F.lit(", flag: "), "l_returnflag", F.lit(") -> float: ..."),
    )
    t.lineitem.select(
        F.concat(module, F.lit(".pyi")).alias("file"),
        module.alias("module_name"),
        F.lit("Line").alias("class_path"),
        F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("function_name"),
        signature.alias("text"),
        F.col("l_partkey").cast("int").alias("line"),
    ).write.json(path)
    return RD.read_reference_stubs(t.spark, path)


@bound(
    "src7_ambiguous_modules",
    """
    SELECT split_part(url, '/', 3) AS module_name, count(*) AS files FROM pages GROUP BY 1 HAVING count(*) > 1
    """,
)
def src7_ambiguous(t):
    return RD.ambiguous_modules(t.pages.select(F.split_part("url", F.lit("/"), F.lit(3)).alias("module_name")))


@bound(
    "snk1_write_function_records",
    """
    SELECT o_orderpriority || ':order_' || o_orderkey AS function_id, n AS signature_count,
           CASE WHEN o_orderstatus = 'P' THEN 'true' ELSE 'false' END AS has_reason, 'false' AS has_class
    FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
    """,
)
def snk1(t):
    path = shared_folder(t.spark, "records")
    functions = order_functions(t).withColumn("failure_reason", X.strip(X.blank_to_null("failure_reason")))
    WR.write_function_records(functions, path)
    lines = t.spark.read.text(path)
    return lines.select(
        F.get_json_object("value", "$.function_id").alias("function_id"),
        F.json_array_length(F.get_json_object("value", "$.signatures")).cast("bigint").alias("signature_count"),
        text(F.contains("value", F.lit('"failure_reason"'))).alias("has_reason"),
        text(F.contains("value", F.lit('"class_name"'))).alias("has_class"),
    )


@bound("snk2_write_measurements", _MEASURED_SQL)
def snk2(t):
    path = shared_folder(t.spark, "measurements")
    WR.write_measurements(event_measurements(t), path)
    return RD.read_measurements(t.spark, path).select(
        "function_id", "elapsed_ns", "elapsed_ms", "provider", "failure_reason"
    )


@bound(
    "snk3_write_summary",
    """
    SELECT count(*) AS functions, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS min,
           max(value) AS max, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.9) AS INT) + 1] AS p90,
           count(DISTINCT event_type) AS files
    FROM events
    """,
)
def snk3(t):
    path = shared_folder(t.spark, "summary")
    WR.write_summary(timing_summary(t.events, "value"), path, t.events, "event_type")
    read = t.spark.read.schema(
        "functions bigint, total double, avg double, min double, max double, p90 double"
    ).json(path)
    return read.select(
        "functions", F.round("total", 4).alias("total"), F.round("avg", 6).alias("mean"), "min", "max", "p90",
        t.spark.read.schema("input_file string").json(f"{path}-files").agg(F.count(F.lit(1))).scalar().alias("files"),
    )


@bound(
    "snk4_write_module_texts",
    """
    SELECT n_name AS module, 'def ' || replace(c_name, '#', '_') || '(): ...' AS value
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    """,
)
def snk4(t):
    path = shared_folder(t.spark, "texts")
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    lines = named.select(
        F.col("n_name").alias("module"),
        F.col("c_custkey").alias("position"),
        F.concat(F.lit("def "), F.replace("c_name", F.lit("#"), F.lit("_")), F.lit("(): ...")).alias("line"),
    )
    WR.write_module_texts(lines, path)
    return t.spark.read.schema("value string, module string").text(path).select("module", "value")


@bound(
    "snk5_append_evaluations",
    "SELECT event_id, event_type, props FROM events",
)
def snk5(t):
    path, state = shared_folder(t.spark, "appended"), shared_folder(t.spark, "state")
    stream = (
        t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    )
    WR.append_evaluations(stream, path, state, ["event_id", "event_type", "props"]).awaitTermination()
    return t.spark.read.schema("event_id bigint, event_type string, props string").csv(path, header=True, escape='"')


@bound(
    "snk6_write_report",
    """
    WITH hits AS (
        SELECT page_id, 'script' AS type FROM pages WHERE contains(html, '<script')
        UNION SELECT page_id, 'layout' FROM pages WHERE contains(html, '<nav') OR contains(html, '<table')
        UNION SELECT page_id, 'ad' FROM pages WHERE contains(html, 'class="ad"')
        UNION SELECT page_id, 'content' FROM pages WHERE contains(html, '<article'))
    SELECT '- ' || type || ': ' || count(*) AS value FROM hits GROUP BY type
    """,
)
def snk6(t):
    path = shared_folder(t.spark, "report")
    hits = match_keywords(t.pages, PAGE_KEYWORDS, "page_id", "html")
    WR.write_report(WR.markdown_counts(type_coverage(hits, "page_id"), "type", "owners"), path, format="text")
    return t.spark.read.text(path)


@bound(
    "prj1_name_parts",
    """
    SELECT c_custkey, string_split(c_name, '#')[2] AS leaf, string_split(c_name, '#')[1] AS parent FROM customer
    """,
)
def prj1(t):
    parts = P.with_name_parts(t.customer, "c_name", "#")
    return parts.select("c_custkey", F.col("name_leaf").alias("leaf"), F.col("name_parent").alias("parent"))


@bound(
    "prj2_function_id",
    """
    SELECT s_suppkey, r_name || ':' || CASE WHEN r_regionkey = 0 THEN '' ELSE n_name || '.' END || s_name AS function_id
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    """,
)
def prj2(t):
    joined = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    named = joined.withColumn("class_name", F.when(F.col("r_regionkey") != 0, F.col("n_name")))
    return P.with_function_id(named, "r_name", "class_name", "s_name").select("s_suppkey", "function_id")


@bound(
    "prj3_explode_signatures",
    f"""
    SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER_SQL}) - 1 AS signature_index,
           count(*) OVER (PARTITION BY l_orderkey) AS signature_count, l_partkey
    FROM lineitem
    """,
)
def prj3(t):
    rows = P.explode_signatures(ordered_lines(t), "lines")
    return rows.select(
        "l_orderkey",
        F.col("signature_index").cast("bigint").alias("signature_index"),
        F.col("signature_count").cast("bigint").alias("signature_count"),
        F.col("signature.l_partkey").alias("l_partkey"),
    )


@bound(
    "prj4_collect_signatures",
    """
    SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ','
                                  ORDER BY l_linenumber, l_partkey, l_suppkey) AS signatures
    FROM lineitem GROUP BY 1
    """,
)
def prj4(t):
    grouped = P.collect_signatures(t.lineitem, ["l_orderkey"], "l_linenumber", ["l_partkey", "l_suppkey"])
    joined = F.transform(
        "signatures", lambda s: F.concat_ws(":", *[s[c].cast("string") for c in LINE_ORDER[:3]])
    )
    return grouped.select("l_orderkey", F.array_join(joined, ",").alias("signatures"))


@bound(
    "prj5_evidence",
    """
    SELECT page_id, CASE WHEN url LIKE '%/fr/%' AND NOT contains(html, '<nav') THEN NULL
        ELSE '{' || concat_ws(',', CASE WHEN url NOT LIKE '%/fr/%' THEN '"location":"' || url || '"' END,
                              CASE WHEN contains(html, '<nav') THEN '"body":"nav"' END) || '}' END AS evidence
    FROM pages
    """,
)
def prj5(t):
    facts = t.pages.select(
        "page_id",
        F.when(F.contains("url", F.lit("/fr/")), F.lit("  ")).otherwise(F.col("url")).alias("location"),
        F.when(F.contains("html", F.lit("<nav")), F.lit("nav")).otherwise(F.lit("")).alias("body"),
    )
    return P.with_evidence(facts, ["location", "body"]).where(F.lit(True)).select("page_id", "evidence")


@bound(
    "prj6_flatten_tree",
    """
    WITH RECURSIVE nodes AS (
        SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name FROM region
        UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
        UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer),
    walk(node_id, path, depth) AS (
        SELECT id, name, 0 FROM nodes WHERE parent IS NULL
        UNION ALL SELECT n.id, w.path || '.' || n.name, w.depth + 1 FROM nodes n JOIN walk w ON n.parent = w.node_id)
    SELECT node_id, path, CAST(depth AS INTEGER) AS depth FROM walk
    """,
)
def prj6(t):
    def ids(prefix, key):
        return F.concat(F.lit(prefix), F.col(key).cast("string"))

    nodes = (
        t.region.select(ids("r", "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"))
        .unionByName(t.nation.select(ids("n", "n_nationkey").alias("node_id"), ids("r", "n_regionkey").alias("parent_id"), F.col("n_name").alias("name")))
        .unionByName(t.customer.select(ids("c", "c_custkey").alias("node_id"), ids("n", "c_nationkey").alias("parent_id"), F.col("c_name").alias("name")))
    )
    return P.flatten_tree(nodes).select("node_id", "path", "depth")


@bound(
    "prj6_deep_tree",
    """
    SELECT event_id AS node_id, (event_id % 100)::INTEGER AS depth,
        md5((SELECT string_agg('n' || i, '.' ORDER BY i) FROM range(event_id - event_id % 100, event_id + 1) r(i))) AS path
    FROM events
    """,
)
def prj6_deep(t):
    """Events as nodes below the one before, a hundred to a stem."""
    key = F.col("event_id")
    nodes = t.events.select(
        key.alias("node_id"), F.when(key % 100 != 0, key - 1).alias("parent_id"), F.concat(F.lit("n"), key.cast("string")).alias("name")
    )
    return P.flatten_tree(nodes).select("node_id", "depth", F.md5("path").alias("path"))


@bound(
    "prj7_classify_callable",
    """
    SELECT o_orderkey,
        CASE WHEN o_orderpriority = '1-URGENT' THEN CASE WHEN o_orderstatus = 'F' THEN 'module_function' END
             WHEN o_orderstatus = 'F' THEN NULL
             WHEN o_orderpriority = '2-HIGH' THEN 'instance_method' WHEN o_orderpriority = '3-MEDIUM' THEN 'class_method'
             WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'static_method' ELSE 'instance_method' END AS callable_kind,
        CASE WHEN o_orderpriority = '1-URGENT' THEN CASE WHEN o_orderstatus = 'F' THEN 'c_extension' END
             WHEN o_orderstatus = 'F' THEN NULL
             WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'c_extension'
             WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'O' THEN 'c_extension'
             ELSE 'pybind11' END AS provider,
        CASE WHEN o_orderstatus <> 'F' AND o_orderpriority = '3-MEDIUM' THEN 'classmethod'
             WHEN o_orderstatus <> 'F' AND o_orderpriority = '4-NOT SPECIFIED' THEN 'staticmethod' END AS decorator
    FROM orders
    """,
)
def prj7(t):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    marked = P.classify_callable(
        t.orders,
        has_owner=s != "F",
        builtin=p.isin("1-URGENT", "4-NOT SPECIFIED", "5-LOW"),
        bound_to_pybind=(p == "5-LOW") | ((p == "4-NOT SPECIFIED") & (s == "P")),
        method_descriptor=p == "2-HIGH",
        class_method_descriptor=p == "3-MEDIUM",
        instance_method=p == "5-LOW",
        static_wrapper=p == "4-NOT SPECIFIED",
    )
    return marked.select("o_orderkey", "callable_kind", "provider", "decorator")


@bound(
    "prj8_decode_call_flags",
    """
    SELECT p_partkey,
        CASE WHEN p_size & 4 <> 0 THEN 'noargs' WHEN p_size & 8 <> 0 THEN 'single' WHEN p_size & 128 <> 0 THEN 'fastcall'
             WHEN p_size & 3 = 3 THEN 'varargs_keywords' WHEN p_size & 1 <> 0 THEN 'varargs' ELSE 'unknown' END AS convention,
        CASE WHEN p_size & 12 <> 0 THEN 'success' ELSE 'failed' END AS status,
        CASE WHEN p_size & 4 <> 0 THEN '' WHEN p_size & 8 <> 0 THEN 'arg' WHEN p_size & 3 = 3 THEN 'args,kwargs'
             WHEN p_size & 1 <> 0 THEN 'args' ELSE '' END AS names
    FROM part
    """,
)
def prj8(t):
    decoded = P.decode_call_flags(t.part, "p_size")
    names = F.array_join(F.transform(F.element_at("args", 1), lambda a: a["name"]), ",")
    return decoded.select("p_partkey", "convention", F.col("parameter_inference_status").alias("status"), names.alias("names"))


@bound(
    "prj9_add_receiver",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
        CASE WHEN l_linestatus = 'F' AND (l_linenumber * 16) & 32 = 0
             THEN CASE WHEN (l_linenumber * 16) & 16 <> 0 THEN 'cls,' ELSE 'self,' END ELSE '' END || 'a' AS names,
        CASE WHEN l_linestatus = 'F' AND (l_linenumber * 16) & 32 = 0
             THEN CASE WHEN l_returnflag = 'A' THEN 'POSITIONAL_ONLY,' ELSE 'POSITIONAL_OR_KEYWORD,' END ELSE '' END
        || CASE WHEN l_returnflag = 'A' THEN 'POSITIONAL_ONLY' ELSE 'KEYWORD_ONLY' END AS kinds
    FROM lineitem
    """,
)
def prj9(t):
    kind = F.when(F.col("l_returnflag") == "A", F.lit(S.POSITIONAL_ONLY)).otherwise(F.lit(S.KEYWORD_ONLY))
    none = F.lit(None).cast("string")
    argument = F.struct(F.lit("a").alias("name"), none.alias("type"), none.alias("default_value"), kind.alias("kind"))
    rows = t.lineitem.withColumns({"args": F.array(argument), "flags": F.col("l_linenumber") * 16})
    added = P.add_receiver(rows, "args", F.col("l_linestatus") == "F", "flags")
    return added.select(
        "l_orderkey", *LINE_ORDER,
        F.array_join(F.transform("args", lambda a: a["name"]), ",").alias("names"),
        F.array_join(F.transform("args", lambda a: a["kind"]), ",").alias("kinds"),
    )


@bound(
    "prj10_override_failed",
    """
    SELECT l.doc_id,
        CASE WHEN lang <> 'en' THEN 'rule_unqualified' WHEN quality = 1 THEN 'qualified' ELSE 'unqualified' END AS parameter_type_code,
        CASE WHEN source <> 'src0' THEN 'rule_unqualified' WHEN toxic = 1 THEN 'unqualified' ELSE 'qualified' END AS return_type_code
    FROM labels l JOIN documents d ON l.doc_id = d.doc_id
    """,
)
def prj10(t):
    judged = t.labels.join(t.documents.select("doc_id", "lang", "source"), "doc_id").select(
        "doc_id",
        F.when(F.col("quality") == 1, "qualified").otherwise("unqualified").alias("parameter_type_code"),
        F.when(F.col("toxic") == 1, "unqualified").otherwise("qualified").alias("return_type_code"),
        F.when(F.col("lang") == "en", "success").otherwise("failed").alias("p_status"),
        F.when(F.col("source") == "src0", "success").otherwise("failed").alias("r_status"),
    )
    governed = {"parameter_type": "p_status", "return_type": "r_status"}
    return P.override_failed(judged, dimensions=governed).select("doc_id", "parameter_type_code", "return_type_code")


@bound(
    "flt1_own_members",
    """
    SELECT c_custkey FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey
    WHERE c_name <> 'annotations' AND NOT (c_mktsegment <> 'MACHINERY' AND s_nationkey IS DISTINCT FROM c_nationkey)
    """,
)
def flt1(t):
    members = t.customer.join(t.supplier, F.col("c_custkey") == F.col("s_suppkey"), "left")
    kept = FL.own_members(members, "c_name", F.col("c_mktsegment") != "MACHINERY", "s_nationkey", "c_nationkey")
    return kept.select("c_custkey")


@bound(
    "flt2_drop_internal",
    """
    SELECT p_partkey, p_name FROM part
    WHERE p_name NOT IN ('red widget', 'hot gear') AND NOT starts_with(p_name, 'small') AND p_brand <> 'Brand#2'
    """,
)
def flt2(t):
    kept = FL.drop_internal(t.part, "p_name", ["red widget", "hot gear"], ["small"], "p_brand", "Brand#2")
    return kept.select("p_partkey", "p_name")


@bound(
    "flt3_blank_to_null",
    """
    SELECT doc_id, pos, CASE WHEN trim(line, ' ' || chr(9) || chr(13)) <> '' THEN line END AS line
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS pos
          FROM documents)
    """,
)
def flt3(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return FL.blank_to_null(lines, ["line"])


@bound(
    "flt4_check_domain",
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'illegal o_orderstatus: ' || o_orderstatus
                            WHEN o_orderpriority = '5-LOW' THEN 'illegal o_orderpriority: 5-LOW' END AS violation
    FROM orders
    """,
)
def flt4(t):
    rules = {"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]}
    return FL.check_domain(t.orders, rules, ["o_orderkey"], mode="mark").select("o_orderkey", "violation")


_ROUTED_SQL = """
    SELECT l_returnflag, l_linestatus,
           CASE WHEN l_returnflag <> 'A' AND l_linestatus <> 'F' THEN 'immediate' ELSE 'pending' END AS route, count(*) AS n
    FROM lineitem GROUP BY 1, 2, 3
"""


def line_statuses(t):
    return t.lineitem.select(
        "l_returnflag",
        "l_linestatus",
        F.when(F.col("l_returnflag") == "A", "success").otherwise("failed").alias("p"),
        F.when(F.col("l_linestatus") == "F", "success").otherwise("failed").alias("r"),
    )


@bound("flt5_split_double_failures", _ROUTED_SQL)
def flt5(t):
    failed, pending = FL.split_double_failures(line_statuses(t), "p", "r")
    both = failed.withColumn("route", F.lit("immediate")).unionByName(pending.withColumn("route", F.lit("pending")))
    return both.groupBy("l_returnflag", "l_linestatus", "route").agg(F.count(F.lit(1)).alias("n"))


@bound(
    "flt6_drop_hidden",
    """
    SELECT p_partkey, 'f(int64_t a=' || p_size || ')' AS signature FROM part WHERE p_type NOT IN ('ECONOMY', 'PROMO')
    """,
)
def flt6(t):
    suffix = F.when(F.col("p_type") == "ECONOMY", "|hidden").when(F.col("p_type") == "PROMO", "|deprecated").otherwise("")
    texts = t.part.select(
        "p_partkey",
        F.concat(F.lit("f(int64_t a="), F.col("p_size").cast("string"), F.lit(")"), suffix).alias("signature"),
    )
    return FL.drop_hidden(texts, "signature")


@bound(
    "flt7_bases_until",
    """
    WITH firsts AS (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2),
    stops AS (SELECT user_id, min(f) AS stop FROM firsts WHERE event_type = 'error' GROUP BY 1)
    SELECT u.user_id, coalesce(string_agg(event_type, ',' ORDER BY f)
               FILTER (WHERE event_type <> 'view' AND (stop IS NULL OR f < stop)), '') AS bases
    FROM firsts u LEFT JOIN stops s ON u.user_id = s.user_id GROUP BY 1
    """,
)
def flt7(t):
    first = t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"))
    listed = first.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("f", "event_type"))).alias("b"))
    bases = listed.select("user_id", F.transform("b", lambda x: x["event_type"]).alias("bases"))
    return FL.bases_until(bases, "bases", "error", skip="view").select("user_id", F.array_join("bases", ",").alias("bases"))
