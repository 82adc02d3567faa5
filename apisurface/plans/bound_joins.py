"""Joins and aggregations on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from apisurface.functions.types import ANY
from apisurface.operators import aggregates as A
from apisurface.operators import joins as J
from apisurface.operators.windows import dedupe
from apisurface.plans.bound_rows import PAGE_KEYWORDS, label_evaluations, order_functions
from apisurface.plans.registry import bound, text
from apisurface.skew import last_before


def nation_rules(t):
    """Rules name -> type made of nations, without those of region 2."""
    rows = t.nation.where(F.col("n_regionkey") != 2)
    return rows.select(F.col("n_nationkey").cast("string").alias("name"), F.col("n_name").alias("type"))


@bound(
    "jn1_apply_rules",
    """
    SELECT s_suppkey, coalesce(n_name, 'object') AS type
    FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey <> 2
    """,
)
def jn1(t):
    named = t.supplier.select("s_suppkey", F.col("s_nationkey").cast("string").alias("name"))
    return J.apply_rules(named, nation_rules(t), "name", F.lit("object"), out="type").select("s_suppkey", "type")


@bound(
    "jn2_merge_rules",
    """
    WITH packs AS (
        SELECT c_nationkey AS k, max(c_acctbal) AS v, 0 AS p FROM customer GROUP BY 1
        UNION ALL SELECT s_nationkey, max(s_acctbal), 1 FROM supplier GROUP BY 1)
    SELECT 'balance' AS category, CAST(k AS VARCHAR) AS name, arg_max(v, p) AS type FROM packs GROUP BY 2
    """,
)
def jn2(t):
    def pack(table, key, value, priority):
        best = table.groupBy(key).agg(F.max(value).alias("type"))
        return best.select(
            F.lit("balance").alias("category"), F.col(key).cast("string").alias("name"), "type", F.lit(priority).alias("priority")
        )

    packs = [pack(t.customer, "c_nationkey", "c_acctbal", 0), pack(t.supplier, "s_nationkey", "s_acctbal", 1)]
    return J.merge_rules(packs).drop("priority")


@bound(
    "jn3_match_references",
    """
    SELECT o_orderkey, refs FROM orders LEFT JOIN (
        SELECT l_orderkey, string_agg(l_linenumber || '/' || l_partkey || '/' || l_suppkey, ' '
                                      ORDER BY l_linenumber, l_partkey, l_suppkey) AS refs
        FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
    """,
)
def jn3(t):
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    matched = J.match_references(
        t.orders.select("o_orderkey"), lines, ["o_orderkey"], "l_linenumber", ["l_partkey", "l_suppkey"]
    )
    shown = F.transform(
        "references", lambda r: F.concat_ws("/", *[r[c].cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")])
    )
    return matched.select("o_orderkey", F.array_join(shown, " ").alias("refs"))


def micros(col):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({col} AS TIMESTAMP_NTZ))")


def signup_ranges(t):
    """Ranges from each signup of a user to the next one; the last is open."""
    starts = t.events.where(F.col("event_type") == "signup").select(
        "user_id", F.col("event_id").alias("signup_id"), micros("ts").alias("low")
    )
    # The next signup is the last one before when time runs backwards.
    backwards = starts.withColumns({"_back": -F.col("low"), "_back_id": -F.col("signup_id")})
    return last_before(
        backwards, ["user_id"], ["_back", "_back_id"], F.col("low"), "high", bucket=-F.floor(F.col("low") / 86_400_000_000)
    ).drop("_back", "_back_id")


@bound(
    "jn4_locate_ranges",
    """
    WITH s AS (SELECT user_id, event_id AS signup_id, ts AS low, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS high
               FROM events WHERE event_type = 'signup')
    SELECT e.event_id, s.signup_id, CASE WHEN s.signup_id IS NULL THEN 'no range holds the address' END AS error
    FROM (SELECT * FROM events WHERE event_type <> 'signup') e
    LEFT JOIN s ON e.user_id = s.user_id AND e.ts >= s.low AND (s.high IS NULL OR e.ts < s.high)
    """,
)
def jn4(t):
    points = t.events.where(F.col("event_type") != "signup").select("event_id", "user_id", micros("ts").alias("at"))
    located = J.locate_ranges(
        points, signup_ranges(t), ["user_id"], "at", ["event_id"], "low", "high", bin_width=3_600_000_000
    )
    return located.select("event_id", "signup_id", "error")


@bound(
    "jn4_open_ranges",
    """
    WITH s AS (SELECT user_id, event_id AS signup_id, ts AS low, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS high
               FROM events WHERE event_type = 'signup')
    SELECT e.event_id, coalesce(s.signup_id, -1) AS signup_id
    FROM (SELECT * FROM events WHERE event_type <> 'signup') e
    LEFT JOIN s ON e.user_id = s.user_id AND e.ts >= s.low AND (s.high IS NULL OR e.ts < s.high)
    """,
)
def jn4_open(t):
    """A second open range per user, from the start of time, holds what no other does."""
    points = t.events.where(F.col("event_type") != "signup").select("event_id", "user_id", micros("ts").alias("at"))
    outer = t.events.select("user_id").distinct().select(
        "user_id", F.lit(-1).cast("bigint").alias("signup_id"), F.lit(0).cast("bigint").alias("low"), F.lit(None).cast("bigint").alias("high")
    )
    ranges = signup_ranges(t).unionByName(outer)
    located = J.locate_ranges(points, ranges, ["user_id"], "at", ["event_id"], "low", "high", bin_width=3_600_000_000)
    return located.select("event_id", "signup_id")


@bound(
    "jn5_join_by_identity",
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN c_name ELSE r_name END AS definition
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN region ON r_regionkey = CAST(substr(o_orderpriority, 1, 1) AS INT) - 1
    """,
)
def jn5(t):
    orders = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("linkage"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("rank"),
    )
    by_linkage = t.customer.select(F.col("c_custkey").alias("linkage"), F.col("c_name").alias("definition"))
    by_name = t.region.select(F.col("r_regionkey").alias("rank"), F.col("r_name").alias("definition"))
    return J.join_by_identity(orders, by_linkage, by_name, "linkage", "rank").select("o_orderkey", "definition")


@bound("jn6_missing_references", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn6(t):
    return J.missing_references(t.documents.select("doc_id"), t.labels, ["doc_id"])


@bound(
    "jn7_choose_reference",
    """
    SELECT d.doc_id,
        CASE WHEN toxic = 1 THEN 'local' WHEN quality IS NOT NULL THEN 'manual_stub' WHEN lang = 'en' THEN 'signature_evidence'
             ELSE 'missing' END AS reference_kind,
        CASE WHEN toxic = 1 THEN 'toxic' WHEN quality IS NOT NULL THEN 'q' || quality WHEN lang = 'en' THEN source END AS reference
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    """,
)
def jn7(t):
    joined = t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id", "left")
    candidates = [
        ("local", F.when(F.col("toxic") == 1, F.lit("toxic"))),
        ("manual_stub", F.concat(F.lit("q"), F.col("quality").cast("string"))),
        ("signature_evidence", F.when(F.col("lang") == "en", F.col("source"))),
    ]
    return J.choose_reference(joined, candidates).select("doc_id", "reference_kind", "reference")


def provider_outcomes(t):
    """Orders with an outcome per provider: by status for one, by market segment for the other."""
    status, segment = F.col("o_orderstatus"), F.col("c_mktsegment")
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return J.complete_with_fallback(
        joined.select(
            "o_orderkey",
            "o_orderpriority",
            F.when(status == "F", "ok").when(status == "O", "unsupported").alias("c_outcome"),
            F.lit("in host binary").alias("c_reason"),
            F.when(segment == "BUILDING", "ok")
            .when(segment == "MACHINERY", "unsupported")
            .when(segment == "HOUSEHOLD", "partial")
            .when(segment == "FURNITURE", "error")
            .alias("pybind_outcome"),
            F.concat(F.lit("bad "), segment).alias("pybind_reason"),
        )
    )


_OUTCOMES_SQL = """
    SELECT o_orderkey,
        CASE WHEN o_orderstatus = 'F' THEN 'c_extension'
             WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD', 'FURNITURE') THEN 'pybind11' END AS provider,
        CASE WHEN o_orderstatus = 'F' OR c_mktsegment = 'BUILDING' THEN 'completed'
             WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'failed' ELSE 'unsupported' END AS outcome,
        CASE WHEN o_orderstatus = 'F' OR c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 'success'
             WHEN c_mktsegment = 'FURNITURE' THEN 'failed' END AS mapping_status,
        CASE WHEN o_orderstatus = 'F' OR c_mktsegment = 'BUILDING' THEN NULL
             WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE', 'MACHINERY') THEN 'bad ' || c_mktsegment
             WHEN o_orderstatus = 'O' THEN 'in host binary' ELSE 'no provider handles this function' END AS failure_reason,
        CASE WHEN o_orderstatus <> 'F' AND c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN '(*args, **kwargs)' END AS signature
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey
"""


@bound("jn8_complete_with_fallback", _OUTCOMES_SQL)
def jn8(t):
    minimal = F.when(F.col("use_minimal"), F.lit(J.MINIMAL_SIGNATURE)).alias("signature")
    return provider_outcomes(t).select("o_orderkey", "provider", "outcome", "mapping_status", "failure_reason", minimal)


@bound(
    "jn9_refine_by_checks",
    """
    SELECT c_custkey, coalesce(refined, 'object') AS refined_type FROM customer LEFT JOIN (
        SELECT o_custkey, array_to_string(list_sort(list(DISTINCT lower(split_part(o_orderpriority, '-', 2)))), ' | ') AS refined
        FROM orders WHERE o_orderpriority <> '3-MEDIUM' GROUP BY 1) ON o_custkey = c_custkey
    """,
)
def jn9(t):
    rules = (
        t.orders.select(F.col("o_orderpriority").alias("name")).distinct()
        .where(F.col("name") != "3-MEDIUM")
        .withColumn("type", F.lower(F.split_part("name", F.lit("-"), F.lit(2))))
    )
    args = t.customer.select("c_custkey", F.lit("x").alias("var"))
    checks = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.lit("x").alias("var"), F.col("o_orderpriority").alias("call_name"))
    return J.refine_by_checks(args, checks, rules, ["c_custkey", "var"]).select("c_custkey", "refined_type")


_HITS_SQL = """
    SELECT page_id, k.keyword AS keyword, k.type AS type
    FROM pages, (VALUES ('<script', 'script'), ('<nav', 'layout'), ('<table', 'layout'), ('class="ad"', 'ad'),
                        ('<article', 'content')) k(keyword, type)
    WHERE contains(html, k.keyword)
"""


@bound("jn10_match_keywords", _HITS_SQL)
def jn10(t):
    return J.match_keywords(t.pages, PAGE_KEYWORDS, "page_id", "html")


@bound(
    "ag1_completion_summary",
    f"""
    SELECT count(*) FILTER (WHERE outcome <> 'unsupported') AS total,
           count(*) FILTER (WHERE outcome = 'completed' AND provider = 'c_extension') AS c_extension,
           count(*) FILTER (WHERE outcome = 'completed' AND provider = 'pybind11') AS pybind11,
           count(*) FILTER (WHERE outcome = 'failed') AS failed
    FROM ({_OUTCOMES_SQL})
    """,
)
def ag1(t):
    return A.completion_summary(provider_outcomes(t))


@bound(
    "ag2_funnel",
    """
    SELECT o_orderpriority, total_functions, mapping_success, parameter_success, return_success, both_success,
           round(mapping_success * 100.0 / total_functions, 6)::DOUBLE AS mapping_rate,
           round(parameter_success * 100.0 / nullif(mapping_success, 0), 6)::DOUBLE AS parameter_rate,
           round(return_success * 100.0 / nullif(mapping_success, 0), 6)::DOUBLE AS return_rate,
           round(both_success * 100.0 / nullif(mapping_success, 0), 6)::DOUBLE AS both_rate
    FROM (SELECT o_orderpriority, count(*) AS total_functions, count(*) FILTER (WHERE o_orderstatus <> 'P') AS mapping_success,
                 count(*) FILTER (WHERE o_orderstatus = 'F') AS parameter_success,
                 count(*) FILTER (WHERE o_orderstatus <> 'P' AND o_totalprice > 200000) AS return_success,
                 count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 200000) AS both_success
          FROM orders GROUP BY 1)
    """,
)
def ag2(t):
    def status(cond):
        return F.when(cond, "success").otherwise("failed")

    rows = t.orders.select(
        "o_orderpriority",
        status(F.col("o_orderstatus") != "P").alias("mapping_status"),
        status(F.col("o_orderstatus") == "F").alias("parameter_inference_status"),
        status(F.col("o_totalprice") > 200000).alias("return_inference_status"),
    )
    rates = A.funnel(rows, ["o_orderpriority"])
    return rates.withColumns({c: F.round(c, 6) for c in rates.columns if c.endswith("_rate")})


@bound(
    "ag3_provider_counts",
    "SELECT CASE WHEN event_type = 'view' THEN '<unknown>' ELSE event_type END AS provider, count(*) AS functions FROM events GROUP BY 1",
)
def ag3(t):
    blanked = t.events.select(F.when(F.col("event_type") != "view", F.col("event_type")).otherwise(F.lit("")).alias("provider"))
    return A.provider_counts(blanked)


@bound(
    "ag4_code_counts",
    """
    SELECT d.dimension, d.code, coalesce(n, 0) AS rows
    FROM (SELECT dimension, code FROM (VALUES ('quality'), ('toxic')) a(dimension), (VALUES ('0'), ('1'), ('2')) b(code)) d
    LEFT JOIN (SELECT 'quality' AS dimension, CAST(quality AS VARCHAR) AS code, count(*) AS n FROM labels GROUP BY 2
               UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), count(*) FROM labels GROUP BY 2) c
    ON d.dimension = c.dimension AND d.code = c.code
    """,
)
def ag4(t):
    return A.code_counts(t.labels, {"quality": "quality", "toxic": "toxic"}, [0, 1, 2])


@bound(
    "ag4_evaluation_summary",
    """
    SELECT (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS total_signatures,
           count(*) AS evaluated_rows,
           0::BIGINT AS parameter_structure_rule_unqualified_count,
           count(*) FILTER (WHERE quality <> 1) AS parameter_structure_unqualified_count,
           count(*) FILTER (WHERE quality = 1) AS parameter_structure_qualified_count,
           count(*) FILTER (WHERE toxic = 1) AS parameter_type_rule_unqualified_count,
           0::BIGINT AS parameter_type_unqualified_count,
           count(*) FILTER (WHERE toxic <> 1) AS parameter_type_qualified_count,
           0::BIGINT AS return_type_rule_unqualified_count,
           count(*) FILTER (WHERE quality <> 1) AS return_type_unqualified_count,
           count(*) FILTER (WHERE quality = 1) AS return_type_qualified_count
    FROM labels
    """,
)
def ag4_summary(t):
    return A.evaluation_summary(order_functions(t), label_evaluations(t))


def _rank_sql(col, q, n="count(*)"):
    return f"list_sort(list({col}))[CAST(floor(({n} - 1) * {q}) AS INT) + 1]"


@bound(
    "ag5_timing_summary",
    f"""
    SELECT event_type, count(*) AS functions, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS min,
           max(value) AS max, {_rank_sql('value', 0.5)} AS p50, {_rank_sql('value', 0.9)} AS p90, {_rank_sql('value', 0.95)} AS p95
    FROM events GROUP BY 1
    """,
)
def ag5(t):
    summary = A.timing_summary(t.events, "value", ["event_type"])
    return summary.withColumns({"total": F.round("total", 4), "mean": F.round("avg", 6)}).drop("avg")


@bound(
    "ag6_floor_percentile",
    f"""
    SELECT l_returnflag, {_rank_sql('l_extendedprice', 0.1)} AS p10, {_rank_sql('l_extendedprice', 0.5)} AS p50,
           {_rank_sql('l_extendedprice', 0.99)} AS p99
    FROM lineitem GROUP BY 1
    """,
)
def ag6(t):
    return A.floor_percentiles(t.lineitem, "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p99": 0.99}, ["l_returnflag"])


@bound(
    "ag7_union_types",
    """
    SELECT user_id, coalesce(array_to_string(list_sort(list(DISTINCT event_type) FILTER (WHERE event_type <> 'error')), ' | '),
                             'typing.Any') AS type,
           CASE WHEN count(*) FILTER (WHERE event_type <> 'error') > 0 THEN 'success' ELSE 'failed' END AS status
    FROM events GROUP BY 1
    """,
)
def ag7(t):
    typed = t.events.select("user_id", F.when(F.col("event_type") == "error", "Never").otherwise(F.col("event_type")).alias("t"))
    return A.union_types(typed, ["user_id"], "t")


@bound(
    "ag7_union_types_with_any",
    f"""
    SELECT o_custkey, CASE WHEN bool_or(o_orderpriority = '1-URGENT') THEN '{ANY}'
        ELSE array_to_string(list_sort(list_distinct(flatten(list(
            CASE WHEN o_orderstatus = 'F' THEN ['bool', 'int'] WHEN o_orderstatus = 'O' THEN ['dict[int | str, None]']
                 ELSE ['None', 'str'] END)))), ' | ') END AS type, 'success' AS status
    FROM orders GROUP BY o_custkey
    """,
)
def ag7_any(t):
    status = F.col("o_orderstatus")
    typed = t.orders.select(
        "o_custkey",
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("int | " + ANY))
        .when(status == "F", F.lit("int | bool"))
        .when(status == "O", F.lit("dict[int | str, None]"))
        .otherwise(F.lit("str | None"))
        .alias("t"),
    )
    return A.union_types(typed, ["o_custkey"], "t")


@bound(
    "ag8_module_imports",
    """
    SELECT c_nationkey, array_to_string(list_sort(list_distinct(list_concat(list(DISTINCT o_orderpriority),
        list(DISTINCT CASE WHEN o_totalprice > 490000 THEN 'typing' END)
            FILTER (WHERE o_totalprice > 490000)))), ',') AS imports
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
    """,
)
def ag8(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "c_nationkey", F.array("o_orderpriority").alias("i"), F.when(F.col("o_totalprice") > 490000, 2).otherwise(1).alias("n")
    )
    return A.module_imports(rows, ["c_nationkey"], "i", F.col("n")).select("c_nationkey", F.array_join("imports", ",").alias("imports"))


@bound("ag9_type_coverage", f"SELECT type, count(DISTINCT page_id) AS owners FROM ({_HITS_SQL}) GROUP BY 1")
def ag9(t):
    return A.type_coverage(J.match_keywords(t.pages, PAGE_KEYWORDS, "page_id", "html"), "page_id")


@bound(
    "ag10_group_hits",
    f"""
    SELECT page_id, string_agg(type || '=' || kws, ';' ORDER BY type) AS extensions
    FROM (SELECT page_id, type, string_agg(keyword, ',' ORDER BY keyword) AS kws FROM ({_HITS_SQL}) GROUP BY 1, 2) GROUP BY 1
    """,
)
def ag10(t):
    grouped = A.group_hits(J.match_keywords(t.pages, PAGE_KEYWORDS, "page_id", "html"), "page_id")
    shown = F.transform("extensions", lambda e: F.concat(e["type"], F.lit("="), F.array_join(e["keywords"], ",")))
    return grouped.select("page_id", F.array_join(shown, ";").alias("extensions"))


@bound(
    "ag11_timing_rollup",
    f"""
    SELECT coalesce(event_type, '<all>') AS event_type, CASE WHEN grouping(event_type) = 1 THEN 'true' ELSE 'false' END AS is_total,
           count(*) AS functions, count(DISTINCT user_id) AS files, min(value) AS min, max(value) AS max,
           round(avg(value), 6) AS mean, {_rank_sql('value', 0.5)} AS p50, {_rank_sql('value', 0.9)} AS p90,
           {_rank_sql('value', 0.95)} AS p95
    FROM events GROUP BY ROLLUP (event_type)
    """,
)
def ag11(t):
    rolled = A.timing_rollup(t.events, "value", "event_type", file="user_id")
    return rolled.withColumns({"mean": F.round("avg", 6), "is_total": text(F.col("is_total"))}).drop("avg", "total")


@bound(
    "ag12_coverage",
    """
    SELECT count(*) AS total, count(l.doc_id) AS labelled, count(*) FILTER (WHERE toxic = 1) AS toxic
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    """,
)
def ag12(t):
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return A.coverage(joined, {"labelled": F.col("quality").isNotNull(), "toxic": F.col("toxic") == 1})


@bound(
    "ag13_chain_status",
    """
    SELECT l_orderkey, CASE WHEN bool_and(l_returnflag <> 'R') THEN 'true' ELSE 'false' END AS all_ok,
           count(*) FILTER (WHERE l_returnflag = 'R') AS failed,
           coalesce(string_agg('overload=' || l_linenumber || ', part=' || l_partkey, '; ' ORDER BY l_linenumber, l_partkey)
               FILTER (WHERE l_returnflag = 'R'), '') AS messages
    FROM lineitem GROUP BY 1
    """,
)
def ag13(t):
    rows = t.lineitem.withColumn("position", F.struct("l_linenumber", "l_partkey"))
    message = F.concat(
        F.lit("overload="), F.col("l_linenumber").cast("string"), F.lit(", part="), F.col("l_partkey").cast("string")
    )
    chained = A.chain_status(rows, ["l_orderkey"], "position", F.col("l_returnflag") != "R", message)
    return chained.withColumn("all_ok", text(F.col("all_ok")))
