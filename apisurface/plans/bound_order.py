"""Windows, ordering, sets, streams, extension points and version comparison on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from apisurface.operators import ordering as O
from apisurface.operators import sets as ST
from apisurface.operators import versions as V
from apisurface.operators import windows as W
from apisurface.operators.filters import split_double_failures
from apisurface.operators.joins import apply_rules
from apisurface.plans.bound_rows import _ROUTED_SQL, line_statuses
from apisurface.plans.registry import LINE_ORDER, LINE_ORDER_SQL, bound, text
from apisurface.session import shared_folder
from apisurface.sources import writers as WR
from apisurface.streaming import counters as C


@bound(
    "wn1_last_definition",
    """
    SELECT event_id, def_value, CASE WHEN def_value IS NULL OR bad THEN 'false' ELSE 'true' END AS usable FROM (
        SELECT event_id, event_type,
            last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS def_value,
            last_value(CASE WHEN event_type = 'purchase' THEN value < 5 END IGNORE NULLS) OVER w AS bad
        FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    WHERE event_type = 'view'
    """,
)
def wn1(t):
    uses = t.events.where(F.col("event_type") == "view").select("user_id", "ts", "event_id")
    defs = t.events.where(F.col("event_type").isin("purchase", "click")).select("user_id", "ts", "event_id", "event_type", "value")
    found = W.last_definition(
        uses, defs, ["user_id"], ["ts", "event_id"], ["value"],
        ignored=F.col("event_type") == "click", is_null=F.col("value") < 5,
    )
    return found.select("event_id", F.col("value").alias("def_value"), text(F.col("usable")).alias("usable"))


@bound(
    "wn1_initializer",
    """
    SELECT e.event_id, coalesce(e.before, s.value) AS def_value FROM (
        SELECT event_id, event_type, user_id,
            last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS before
        FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) e
    LEFT JOIN (SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_type = 'signup' GROUP BY 1) s
        ON s.user_id = e.user_id
    WHERE event_type = 'view'
    """,
)
def wn1_initializer(t):
    """The last signup of a user is the initializer, though it may come after the view."""
    uses = t.events.where(F.col("event_type") == "view").select("user_id", "ts", "event_id")
    defs = t.events.where(F.col("event_type").isin("purchase", "signup")).select("user_id", "ts", "event_id", "event_type", "value")
    found = W.last_definition(
        uses, defs, ["user_id"], ["ts", "event_id"], ["value"], initial=F.col("event_type") == "signup"
    )
    return found.select("event_id", F.col("value").alias("def_value"))


@bound(
    "wn2_ordinal",
    f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER_SQL}) - 1 AS ordinal
    FROM lineitem
    """,
)
def wn2(t):
    return W.with_ordinal(t.lineitem.select("l_orderkey", *LINE_ORDER), ["l_orderkey"], LINE_ORDER)


@bound(
    "wn3_ecdf",
    """
    SELECT l_quantity, n, sum(n) OVER (ORDER BY l_quantity)::BIGINT AS cumulative,
        CASE WHEN floor((sum(n) OVER () - 1) * 0.9) < sum(n) OVER (ORDER BY l_quantity)
              AND floor((sum(n) OVER () - 1) * 0.9) >= sum(n) OVER (ORDER BY l_quantity) - n
             THEN 'true' ELSE 'false' END AS is_point
    FROM (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1)
    """,
)
def wn3(t):
    return W.ecdf(t.lineitem, "l_quantity").withColumn("is_point", text(F.col("is_point")))


@bound(
    "wn4_markers",
    """
    WITH a AS (
        SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'POSITIONAL_ONLY'
            WHEN o_orderpriority = '3-MEDIUM' THEN 'KEYWORD_ONLY' WHEN o_orderpriority = '5-LOW' THEN 'VAR_POSITIONAL'
            ELSE 'POSITIONAL_OR_KEYWORD' END AS kind FROM orders),
    b AS (
        SELECT *, sum(CASE WHEN kind <> 'POSITIONAL_ONLY' THEN 1 ELSE 0 END) OVER w AS others,
            sum(CASE WHEN kind = 'POSITIONAL_ONLY' THEN 1 ELSE 0 END) OVER w AS leading_only,
            sum(CASE WHEN kind = 'KEYWORD_ONLY' THEN 1 ELSE 0 END) OVER w AS kw,
            sum(CASE WHEN kind = 'VAR_POSITIONAL' THEN 1 ELSE 0 END) OVER w AS var,
            row_number() OVER w AS pos, count(*) OVER (PARTITION BY o_custkey) AS size
        FROM a WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
    SELECT o_custkey, o_orderkey, kind,
        CASE WHEN kind <> 'POSITIONAL_ONLY' AND others = 1 AND leading_only > 0 THEN 'true' ELSE 'false' END AS slash_before,
        CASE WHEN kind = 'KEYWORD_ONLY' AND kw = 1 AND var = 0 THEN 'true' ELSE 'false' END AS star_before,
        CASE WHEN others = 0 AND pos = size THEN 'true' ELSE 'false' END AS slash_after
    FROM b
    """,
)
def wn4(t):
    priority = F.col("o_orderpriority")
    kind = (
        F.when(priority.isin("1-URGENT", "2-HIGH"), "POSITIONAL_ONLY")
        .when(priority == "3-MEDIUM", "KEYWORD_ONLY")
        .when(priority == "5-LOW", "VAR_POSITIONAL")
        .otherwise("POSITIONAL_OR_KEYWORD")
    )
    marked = W.with_markers(t.orders.select("o_custkey", "o_orderkey", kind.alias("kind")), ["o_custkey"], ["o_orderkey"])
    return marked.withColumns({c: text(F.col(c)) for c in ("slash_before", "star_before", "slash_after")})


@bound(
    "wn5_dedupe",
    """
    SELECT c_nationkey, c_mktsegment, arg_min(c_name, c_custkey) AS first_name, arg_max(c_name, c_custkey) AS last_name
    FROM customer GROUP BY 1, 2
    """,
)
def wn5(t):
    keys = ["c_nationkey", "c_mktsegment"]
    rows = t.customer.select(*keys, "c_custkey", "c_name")
    first = W.dedupe(rows, keys, ["c_custkey"], "first").select(*keys, F.col("c_name").alias("first_name"))
    last = W.dedupe(rows, keys, ["c_custkey"], "last").select(*keys, F.col("c_name").alias("last_name"))
    return first.join(last, keys)


@bound(
    "wn6_section",
    """
    SELECT event_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w::BIGINT AS optional_marks,
        CASE WHEN sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w > 0 THEN 'keyword_only'
             WHEN sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w > 0 THEN 'optional' ELSE 'required' END AS section
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """,
)
def wn6(t):
    tokens = t.events.select("event_id", "ts", "user_id", "event_type")
    kind = F.col("event_type")
    return W.with_section(tokens, ["user_id"], ["ts", "event_id"], kind == "signup", kind == "error").select(
        "event_id", "optional_marks", "section"
    )


@bound(
    "sl1_ordered",
    """
    SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS rank FROM nation
    """,
)
def sl1(t):
    ranked = O.ordered_rank(t.nation, ["n_regionkey"], "n_name")
    shown = ranked.withColumn("kind", F.when(F.col("n_nationkey") < 10, "class").otherwise("function"))
    return O.ordered(shown, "kind", "n_name", ["n_regionkey"]).select("n_nationkey", F.col("rank").cast("bigint").alias("rank"))


@bound(
    "sl2_slowest",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
    ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 20
    """,
)
def sl2(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return O.slowest(rows, "l_extendedprice", 20, ["l_orderkey", "l_linenumber", "l_partkey"])


@bound("sl3_first_n", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 100")
def sl3(t):
    return O.first_n(t.part.select("p_partkey", "p_name"), "p_partkey", 100)


@bound("sl4_sample", "SELECT event_id, event_type FROM events ORDER BY md5('0-' || event_id), event_id LIMIT 50")
def sl4(t):
    order = F.md5(F.concat(F.lit("0-"), F.col("event_id").cast("string")))
    return O.sample_k(t.events.select("event_id", "event_type"), 50, 0, "event_id", order=order)


@bound("sl4_sample_hashed", "SELECT event_id, event_type FROM events ORDER BY md5('7-' || event_id), event_id LIMIT 50")
def sl4_hashed(t):
    return O.sample_k(t.events.select("event_id", "event_type"), 50, 7, "event_id")


@bound("st1_combine_rows", _ROUTED_SQL)
def st1(t):
    failed, pending = split_double_failures(line_statuses(t), "p", "r")
    rows = ST.combine_rows(
        failed.withColumn("route", F.lit("immediate")), pending.select(F.lit("pending").alias("route"), "*")
    )
    return rows.groupBy("l_returnflag", "l_linestatus", "route").agg(F.count(F.lit(1)).alias("n"))


@bound(
    "st2_join_names",
    """
    SELECT user_id, string_agg(event_type, '_' ORDER BY f) AS name
    FROM (SELECT user_id, event_type, min((ts, event_id)) AS f FROM events GROUP BY 1, 2) GROUP BY 1
    """,
)
def st2(t):
    return ST.join_distinct_names(t.events, ["user_id"], "event_type", ["ts", "event_id"])


@bound("st3_missing_items", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def st3(t):
    present = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return ST.missing_items(t.orders.select("o_orderkey"), present, ["o_orderkey"])


@bound(
    "st4_reachable",
    """
    SELECT 'c' || c_custkey AS node FROM customer WHERE c_mktsegment = 'BUILDING'
    UNION SELECT 'n' || c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING'
    UNION SELECT 'r' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'
    UNION SELECT 's' || s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN
        (SELECT n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'))
    """,
)
def st4(t):
    def node(prefix, key):
        return F.concat(F.lit(prefix), F.col(key).cast("string"))

    edges = (
        t.customer.select(node("c", "c_custkey").alias("src"), node("n", "c_nationkey").alias("dst"))
        .unionByName(t.nation.select(node("n", "n_nationkey").alias("src"), node("r", "n_regionkey").alias("dst")))
        .unionByName(
            t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
                node("r", "n_regionkey").alias("src"), node("s", "s_suppkey").alias("dst")
            )
        )
        # A way back, so that the graph has cycles.
        .unionByName(t.supplier.select(node("s", "s_suppkey").alias("src"), node("s", "s_suppkey").alias("dst")))
    )
    roots = t.customer.where(F.col("c_mktsegment") == "BUILDING").select(node("c", "c_custkey").alias("node"))
    return ST.reachable(edges, roots)


@bound("st4_long_chains", "SELECT event_id AS node FROM events WHERE event_id % 1000 >= 500")
def st4_chains(t):
    """Events linked to the next of their thousand, reached from the middle of each."""
    later = t.events.where(F.col("event_id") % 1000 != 999)
    edges = later.select(F.col("event_id").alias("src"), (F.col("event_id") + 1).alias("dst"))
    known = t.events.select(F.col("event_id").alias("node"))
    found = ST.reachable(edges, known.where(F.col("node") % 1000 == 500))
    return found.join(known, "node", "left_semi")


@bound("sl4_large_sample", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (ORDER BY md5('3-' || l_orderkey), l_orderkey) AS r FROM (SELECT DISTINCT l_orderkey, 0 AS l_linenumber FROM lineitem)) WHERE r <= 12000")
def sl4_large(t):
    """A sample of more orders than are sorted in one task; a smaller table is given whole."""
    orders = t.lineitem.select("l_orderkey", F.lit(0).alias("l_linenumber")).distinct()
    return O.sample_k(orders, 12_000, 3, "l_orderkey")


def event_stream(t):
    return t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)


def _run(t, df, mode):
    name = "apisurface_" + shared_folder(t.spark, "q").rsplit("-", 1)[-1]
    C.run_available(df, name, shared_folder(t.spark, "state"), mode)
    return t.spark.table(name)


@bound("str1_append_results", "SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def str1(t):
    path, state = shared_folder(t.spark, "appended"), shared_folder(t.spark, "state")
    WR.append_evaluations(event_stream(t), path, state, ["event_id", "event_type"], format="parquet").awaitTermination()
    rows = t.spark.read.schema("event_id bigint, event_type string").parquet(path)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@bound(
    "str2_stream_counters",
    """
    SELECT event_type, count(*) AS functions, count(*) FILTER (WHERE value > 100) AS failed FROM events GROUP BY 1
    """,
)
def str2(t):
    stream = event_stream(t).withColumn("slow", F.col("value") > 100)
    return _run(t, C.stream_counters(stream, ["event_type"], failed="slow"), "complete")


@bound("str3_stream_mean", "SELECT count(value) AS completed, round(avg(value), 6) AS mean FROM events")
def str3(t):
    return _run(t, C.stream_mean(event_stream(t), "value"), "complete").select("completed", F.round("mean", 6).alias("mean"))


@bound(
    "str2_counters_by_batch",
    """
    SELECT event_type, count(*) AS functions, count(*) FILTER (WHERE value > 100) AS failed FROM events GROUP BY 1
    """,
)
def str2_batches(t):
    """Counters written batch by batch and added up; events come once each within the watermark."""
    path = shared_folder(t.spark, "partials")
    known = event_stream(t).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("slow", F.col("value") > 100)
    once = C.without_repeats(known, ["event_id"], "ts")
    C.write_partials(once, path, shared_folder(t.spark, "state"), ["event_type"], failed="slow").awaitTermination()
    return C.read_totals(t.spark, path, ["event_type"])


@bound("str3_mean_by_batch", "SELECT count(value) AS completed, round(avg(value), 6) AS mean FROM events")
def str3_batches(t):
    path = shared_folder(t.spark, "partials")
    C.write_partials(event_stream(t), path, shared_folder(t.spark, "state"), value="value").awaitTermination()
    return C.read_totals(t.spark, path).select("completed", F.round("mean", 6).alias("mean"))


@bound(
    "ud1_computed_rules",
    """
    SELECT event_id, CASE event_type WHEN 'purchase' THEN 'wrapped_' || user_id WHEN 'error' THEN NULL ELSE upper(event_type) END AS type
    FROM events
    """,
)
def ud1(t):
    rules = t.events.select(F.col("event_type").alias("name")).distinct().where(~F.col("name").isin("error", "purchase"))
    named = t.events.select("event_id", "user_id", F.col("event_type").alias("name"))
    computed = {"purchase": F.concat(F.lit("wrapped_"), F.col("user_id").cast("string"))}
    return apply_rules(named, rules.withColumn("type", F.upper("name")), "name", out="type", computed=computed).select("event_id", "type")


_SNAPSHOTS = """
    a AS (SELECT p_partkey, p_brand, p_size FROM part WHERE p_type <> 'PROMO'),
    b AS (SELECT p_partkey, p_brand, CASE WHEN starts_with(p_name, 'red') THEN p_size + 1 ELSE p_size END AS p_size
          FROM part WHERE p_brand <> 'Brand#3')
"""


def part_diff(t):
    """Two versions of the part catalog: one lacks a type, the other a brand and has grown parts."""
    a = t.part.where(F.col("p_type") != "PROMO").select("p_partkey", "p_brand", "p_size")
    grown = F.when(F.startswith("p_name", F.lit("red")), F.col("p_size") + 1).otherwise(F.col("p_size"))
    b = t.part.where(F.col("p_brand") != "Brand#3").select("p_partkey", "p_brand", grown.alias("p_size"))
    return V.diff_catalogs(a, b, ["p_partkey"], ["p_size"], carry=["p_brand"])


_DIFF_SQL = f"""
    WITH {_SNAPSHOTS}
    SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, coalesce(b.p_brand, a.p_brand) AS p_brand,
           CAST(a.p_size AS INTEGER) AS old_p_size, CAST(b.p_size AS INTEGER) AS new_p_size,
           CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'removed'
                WHEN a.p_size IS NOT DISTINCT FROM b.p_size THEN 'unchanged' ELSE 'changed' END AS change
    FROM a FULL OUTER JOIN b ON a.p_partkey = b.p_partkey
"""


@bound("cv1_diff_catalogs", _DIFF_SQL)
def cv1(t):
    return part_diff(t)


@bound(
    "cv1_diff_grouped",
    """
    WITH a AS (SELECT p_partkey, p_brand, p_name, p_size FROM part WHERE p_partkey % 50 <> 7),
         b AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 40 = 3 THEN p_name || '!' ELSE p_name END AS p_name, p_size FROM part WHERE p_partkey % 50 <> 9)
    SELECT p_partkey, coalesce(b.p_brand, a.p_brand) AS p_brand, a.p_name AS old_p_name, b.p_name AS new_p_name,
        CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'removed' WHEN a.p_name IS DISTINCT FROM b.p_name THEN 'changed' ELSE 'unchanged' END AS change
    FROM a FULL OUTER JOIN b USING (p_partkey)
    """,
)
def cv1_grouped(t):
    """Two versions of the parts, matched by key only in groups of brand and size whose digests differ."""
    parts = t.part.select("p_partkey", "p_brand", "p_name", F.concat_ws("/", "p_brand", "p_size").alias("shelf"))
    old = parts.where(F.col("p_partkey") % 50 != 7)
    renamed = F.when(F.col("p_partkey") % 40 == 3, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))
    new = parts.where(F.col("p_partkey") % 50 != 9).withColumn("p_name", renamed)
    return V.diff_grouped(old, new, "shelf", ["p_partkey"], ["p_name"], ["p_brand"]).drop("shelf")


@bound(
    "cv2_diff_summary",
    f"""
    SELECT p_brand, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed,
           count(*) FILTER (WHERE change = 'changed') AS changed, count(*) FILTER (WHERE change = 'unchanged') AS unchanged
    FROM ({_DIFF_SQL}) GROUP BY 1
    """,
)
def cv2(t):
    return V.diff_summary(part_diff(t), "p_brand")
