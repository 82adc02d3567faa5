"""Whole flows on the test tables: facts to records, records to verdicts, timings to statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from apisurface import schemas as S
from apisurface.functions.rule_packs import rule_table
from apisurface.functions.text import function_id
from apisurface.operators.aggregates import evaluation_summary, funnel
from apisurface.operators import projections as P
from apisurface.operators.joins import merge_rules
from apisurface.operators.windows import with_ordinal
from apisurface.plans import completion as CP
from apisurface.plans import evaluation as EV
from apisurface.plans import providers as PV
from apisurface.plans import rendering as RN
from apisurface.plans.bound_rows import order_functions
from apisurface.plans.registry import LINE_ORDER, LINE_ORDER_SQL, bound
from apisurface.session import shared_folder, sized
from apisurface.skew import running_sum
from apisurface.sources import readers as RD
from apisurface.sources import writers as WR


def call_facts(t):
    """Orders as C functions with one parse call, lines as its slots, and returns by status.

    Line flags give the format units: A an int, N an object with a type operand, R an encoded text.
    """
    lines = with_ordinal(
        t.lineitem.select("l_orderkey", *LINE_ORDER, "l_linestatus", "l_returnflag"),
        ["l_orderkey"], [*LINE_ORDER, "l_linestatus", "l_returnflag"], bucketed=False,
    )
    width = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    # The order of the ordinals once more, so that rows are sorted once for both.
    placed = running_sum(lines, ["l_orderkey"], [*LINE_ORDER, "l_linestatus", "l_returnflag"], width, "_before", include_current=False, bucketed=False)
    slots = placed.select(
        F.col("l_orderkey").alias("fn"),
        F.lit(0).alias("call_pos"),
        "ordinal",
        "l_linestatus",
        "l_returnflag",
        "_before",
        F.explode(F.sequence(F.lit(0), width - 1)).alias("k"),
    ).select(
        "fn",
        "call_pos",
        (F.col("_before") + F.col("k")).alias("slot_index"),
        F.concat(F.lit("v"), F.col("ordinal").cast("string"), F.when((F.col("l_returnflag") == "N") & (F.col("k") == 0), F.lit("t")).otherwise(F.lit(""))).alias("var"),
        F.when(
            (F.col("l_returnflag") == "N") & (F.col("k") == 0),
            F.when(F.col("l_linestatus") == "F", F.lit("&PyList_Type")).otherwise(F.lit("&unknownType")),
        ).alias("operand"),
        F.lit(None).cast("string").alias("default_value"),
    )
    unit = F.when(F.col("l_returnflag") == "A", "i").when(F.col("l_returnflag") == "N", "O!").otherwise("es#")
    calls = lines.groupBy(F.col("l_orderkey").alias("fn")).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("ordinal", unit.alias("u")))), lambda x: x["u"]), ""
        ).alias("fmt")
    ).withColumn("call_pos", F.lit(0))
    # An object whose type operand is unknown is checked to be text when its order line is even numbered.
    checks = lines.where((F.col("l_returnflag") == "N") & (F.col("l_linenumber") % 2 == 0)).select(
        F.col("l_orderkey").alias("fn"), F.concat(F.lit("v"), F.col("ordinal").cast("string")).alias("var"),
        F.lit("PyUnicode_Check").alias("call_name"),
    )
    # v0 of an N line names the type operand's partner; the value slot carries the plain name.
    functions = t.orders.select(
        F.col("o_orderkey").alias("fn"),
        F.col("o_orderpriority").alias("module_name"),
        F.when(F.col("o_orderstatus") != "P", F.lit("C")).alias("class_name"),
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("function_name"),
        F.when(F.col("o_orderstatus") == "O", 1 + 32).otherwise(1).alias("flags"),
    )
    status = F.col("o_orderstatus")
    returns = t.orders.select(
        F.col("o_orderkey").alias("fn"),
        F.explode(
            F.array(
                F.struct(F.lit(10).alias("pos"), F.lit("null").alias("expr_kind"), F.lit("").alias("expr_name")),
                F.struct(
                    F.lit(20).alias("pos"),
                    F.when(status == "F", "ref").when(status == "O", "call").otherwise("value_format").alias("expr_kind"),
                    F.when(status == "F", "result").when(status == "O", "PyLong_FromLong").otherwise("(is)").alias("expr_name"),
                ),
            )
        ).alias("r"),
    ).select("fn", "r.*")
    high = F.col("o_totalprice") > 250000
    assigns = t.orders.where(status == "F").select(
        F.col("o_orderkey").alias("fn"),
        F.lit("result").alias("var"),
        F.explode(
            F.array(
                F.struct(F.lit(-1).alias("pos"), F.lit("null").alias("rhs_kind"), F.lit("").alias("rhs_name")),
                F.struct(F.lit(5).alias("pos"), F.when(high, "ref").otherwise("call").alias("rhs_kind"),
                         F.when(high, "other").otherwise("PyFloat_FromDouble").alias("rhs_name")),
                F.struct(F.lit(15).alias("pos"), F.lit("binary").alias("rhs_kind"), F.lit("+").alias("rhs_name")),
            )
        ).alias("a"),
    ).select("fn", "var", "a.*")
    chained = t.orders.where((status == "F") & high).select(
        F.col("o_orderkey").alias("fn"), F.lit("other").alias("var"), F.lit(2).alias("pos"), F.lit("ref").alias("rhs_kind"),
        F.lit("_Py_NoneStruct").alias("rhs_name"),
    )
    return functions, calls, slots, checks, returns, assigns.unionByName(chained)


def _default_rules(t):
    return merge_rules([rule_table(t.spark)])


def completed(t, sink=None):
    functions, calls, slots, checks, returns, assigns = call_facts(t)
    return CP.complete_functions(functions, calls, slots, checks, returns, assigns, _default_rules(t), sink)


_COMPLETED_SQL = f"""
    WITH l AS (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER_SQL}, l_linestatus, l_returnflag) - 1 AS i
        FROM lineitem),
    a AS (
        SELECT l_orderkey, count(*) AS n, string_agg('    ' || CASE l_returnflag WHEN 'R' THEN 'v' || i || ': str'
            WHEN 'A' THEN 'v' || i || ': int'
            ELSE 'v' || i || ': ' || CASE WHEN l_linestatus = 'F' THEN 'list' WHEN l_linenumber % 2 = 0 THEN 'str' ELSE 'object' END
            END || ',' || chr(10), '' ORDER BY i) AS args
        FROM l GROUP BY 1),
    f AS (
        SELECT o_orderkey, o_orderpriority || ':' || CASE WHEN o_orderstatus <> 'P' THEN 'C.' ELSE '' END || 'f' || o_orderkey AS function_id,
            CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_totalprice > 250000 THEN 'None' ELSE 'float' END WHEN 'O' THEN 'int'
                 ELSE 'tuple[int, None | str]' END AS ret, o_orderstatus, n, args
        FROM orders LEFT JOIN a ON l_orderkey = o_orderkey)
    SELECT function_id, CASE WHEN n IS NULL THEN 'failed' ELSE 'success' END AS parameter_inference_status,
        'success' AS return_inference_status,
        CASE WHEN n IS NULL THEN
            CASE WHEN o_orderstatus = 'F' THEN 'def f' || o_orderkey || '(' || chr(10) || '    self,' || chr(10) || '    *args: object,' || chr(10)
                      || ') -> ' || ret || ':'
                 ELSE 'def f' || o_orderkey || '(*args: object) -> ' || ret || ':' END
        WHEN n = 1 AND o_orderstatus <> 'F' THEN 'def f' || o_orderkey || '(' || substr(args, 5, length(args) - 6) || ', /) -> ' || ret || ':'
        ELSE 'def f' || o_orderkey || '(' || chr(10) || CASE WHEN o_orderstatus = 'F' THEN '    self,' || chr(10) ELSE '' END
            || args || '    /,' || chr(10) || ') -> ' || ret || ':' END AS signature
    FROM f
"""


@bound("flow_complete_functions", _COMPLETED_SQL)
def flow_complete(t):
    return completed(t).select(
        "function_id", "parameter_inference_status", "return_inference_status",
        F.element_at("signatures", 1)["signature"].alias("signature"),
    )


@bound("ud3_injected_sink", f"SELECT function_id, 'c_extension' AS provider FROM ({_COMPLETED_SQL})")
def ud3(t):
    path = shared_folder(t.spark, "records")
    completed(t, sink=lambda records: WR.write_function_records(records, path))
    return RD.read_function_records(t.spark, path).select("function_id", "provider")


def answers(t):
    """Judge answers per order and line: fine unless the line is returned, unreadable when it is accepted."""
    lines = with_ordinal(t.lineitem.select("l_orderkey", *LINE_ORDER, "l_returnflag"), ["l_orderkey"], [*LINE_ORDER, "l_returnflag"], bucketed=False)
    code = F.when(F.col("l_returnflag") == "R", F.lit("unqualified")).otherwise(F.lit("qualified"))
    fields = [
        (code if part == "code" else F.lit("reason")).alias(f"{d}_{part}")
        for d in ("parameter_structure", "parameter_type", "return_type") for part in ("code", "reason")
    ]
    answer = F.when(F.col("l_returnflag") != "A", F.to_json(F.struct(*fields)))
    rows = lines.select("l_orderkey", F.col("ordinal").cast("int").alias("signature_index"), answer.alias("answer"), F.lit("thought").alias("reasoning_content"))
    return rows.join(t.orders.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        function_id("o_orderpriority", F.lit(None).cast("string"), F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"))).alias("function_id"),
        "signature_index", "answer", "reasoning_content",
    )


def evaluated(t):
    functions = order_functions(t).where(F.col("mapping_status") == "success")
    half = functions.withColumn(
        "return_inference_status", F.when(F.col("module_name") == "1-URGENT", F.lit("success")).otherwise(F.col("return_inference_status"))
    )
    references = half.where(F.col("module_name") == "2-HIGH").select(
        "module_name", F.lit("").alias("class_path"), "function_name", F.lit(0).alias("ordinal"),
        F.lit("def f(x): ...").alias("text"), F.lit(7).alias("line"),
    )
    pending, immediate = EV.prepare(EV.signature_entries(half), references)
    return half, EV.evaluation_rows(pending, immediate, answers(t))


_EVALUATED_SQL = f"""
    SELECT o_orderpriority || ':order_' || o_orderkey AS function_id, CAST(i AS INTEGER) AS signature_index,
        CASE WHEN o_orderstatus = 'O' THEN 'rule_unqualified' WHEN l_returnflag = 'N' THEN 'qualified' ELSE 'unqualified' END
            AS parameter_type_code,
        CASE WHEN o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT' THEN 'rule_unqualified' WHEN l_returnflag = 'N' THEN 'qualified'
             ELSE 'unqualified' END AS return_type_code,
        CASE WHEN o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT' THEN 'inference_status' WHEN o_orderpriority = '2-HIGH' THEN 'manual_stub'
             ELSE 'signature_evidence' END AS reference_kind,
        CASE WHEN l_returnflag = 'A' AND NOT (o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT') THEN 'llm_error' ELSE 'ok' END AS status
    FROM orders JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER_SQL}, l_returnflag) - 1 AS i FROM lineitem)
        ON l_orderkey = o_orderkey
    WHERE o_orderstatus <> 'P'
"""


_CONVENTIONS_SQL = """
    SELECT o_orderpriority || ':f' || o_orderkey AS function_id,
        replace('def f' || o_orderkey || CASE substr(o_orderpriority, 1, 1)
            WHEN '1' THEN '()'
            WHEN '2' THEN '(arg: ' || CASE WHEN o_orderkey % 2 = 0 THEN 'str' ELSE 'object' END || ', /)'
            WHEN '3' THEN replace('(|    count: int,|    label: str ~ None = ...,|    *,|    target: object = ...,|)', '|', chr(10))
            WHEN '4' THEN replace('(|    v0: int,|    v1: str ~ collections.abc.Buffer,|    /,|)', '|', chr(10))
            ELSE replace('(|    *args: object,|    **kwargs: object,|)', '|', chr(10)) END
        || ' -> ' || CASE o_orderstatus WHEN 'F' THEN 'torch.Tensor' WHEN 'O' THEN 'list' ELSE 'typing.Any' END || ':', '~', '|') AS signature,
        CASE WHEN o_orderpriority = '5-LOW' THEN 'failed' ELSE 'success' END AS parameter_inference_status,
        CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'success' END AS return_inference_status
    FROM orders
"""


@bound("flow_complete_conventions", _CONVENTIONS_SQL)
def flow_conventions(t):
    """Orders as functions of all calling conventions by priority: none, one checked argument, keywords, format, unknown.

    Values are wrapped, created from a type object, or reach the return through initializers that go in a circle.
    """
    fn, kind = F.col("o_orderkey").alias("fn"), F.substring("o_orderpriority", 1, 1)
    functions = t.orders.select(
        fn,
        F.col("o_orderpriority").alias("module_name"),
        F.lit(None).cast("string").alias("class_name"),
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("function_name"),
        F.when(kind == "1", 4).when(kind == "2", 8).when(kind == "4", 1).otherwise(3).alias("flags"),
    )
    names = F.array(F.lit("count"), F.lit("label"), F.lit("target"))
    calls = t.orders.where(kind.isin("3", "4")).select(
        fn, F.lit(0).alias("call_pos"), F.when(kind == "3", "i|z$O").otherwise("is#").alias("fmt"), F.when(kind == "3", names).alias("names")
    )
    slots = t.orders.where(kind.isin("3", "4")).select(fn, F.explode(F.sequence(F.lit(0), F.lit(2))).alias("slot_index")).select(
        "fn", F.lit(0).alias("call_pos"), "slot_index", F.concat(F.lit("v"), F.col("slot_index").cast("string")).alias("var"),
        F.lit(None).cast("string").alias("operand"), F.lit(None).cast("string").alias("default_value"),
    )
    checks = t.orders.where((kind == "2") & (F.col("o_orderkey") % 2 == 0)).select(
        fn, F.lit(CP.SINGLE_ARGUMENT).alias("var"), F.lit("PyUnicode_Check").alias("call_name")
    )
    status = F.col("o_orderstatus")
    returns = t.orders.select(
        fn,
        F.lit(10).alias("pos"),
        F.when(status == "P", "ref").otherwise("call").alias("expr_kind"),
        F.when(status == "F", "wrap").when(status == "O", "PyObject_New").otherwise("a").alias("expr_name"),
        F.when(status == "F", "const at::Tensor &").when(status == "O", "& PyList_Type").alias("expr_detail"),
    )
    circle = F.array(
        F.struct(F.lit("a").alias("var"), F.lit("b").alias("rhs_name")), F.struct(F.lit("b").alias("var"), F.lit("a").alias("rhs_name"))
    )
    assigns = t.orders.where(status == "P").select(fn, F.explode(circle).alias("c")).select(
        "fn", "c.var", F.lit(-1).alias("pos"), F.lit("ref").alias("rhs_kind"), "c.rhs_name"
    )
    done = CP.complete_functions(functions, calls, slots, checks, returns, assigns, merge_rules([rule_table(t.spark)]))
    return done.select(
        "function_id", F.col("signatures")[0]["signature"].alias("signature"), "parameter_inference_status", "return_inference_status"
    )


_KINDS_SQL = """
    SELECT o_orderpriority || ':f' || o_orderkey AS function_id, i::INTEGER AS signature_index,
        replace(replace('def f' || o_orderkey || s, '|', chr(10)), '~', '|') || ' -> ' ||
            CASE k WHEN 0 THEN 'list' WHEN 1 THEN 'None' WHEN 2 THEN 'torch.Tensor' WHEN 3 THEN 'None | torch.Tensor' ELSE 'typing.Any' END || ':' AS signature,
        CASE WHEN k IN (1, 5) THEN 'failed' ELSE 'success' END AS parameter_inference_status,
        CASE WHEN k IN (4, 5) THEN 'failed' ELSE 'success' END AS return_inference_status
    FROM (SELECT *, o_orderkey % 6 AS k FROM orders) JOIN (VALUES
        (0, 0, '(|    v0: object,|    /,|    axis: numpy.typing.ArrayLike = 0,|    *,|    out: str = ...,|)'),
        (1, 0, '(*args: object)'),
        (2, 0, '(v0: str, /)'), (2, 1, '(|    a: object,|    b: int = ...,|)'),
        (2, 2, '(|    input: torch.Tensor,|    dim: None ~ int = None,|    *,|    keepdim: bool = False,|)'),
        (3, 0, '(v0: str, /)'), (3, 1, '(|    input: torch.Tensor,|    dim: None ~ int = None,|    *,|    keepdim: bool = False,|)'),
        (4, 0, '(|    input: torch.Tensor,|    dim: None ~ int = None,|    *,|    keepdim: bool = False,|)'),
        (5, 0, '(*args: object)')) t(kind, i, s) ON k = kind
"""


@bound("flow_conventions_by_kind", _KINDS_SQL)
def flow_kinds(t):
    """Orders as functions whose parse facts are of all kinds; each convention reads its own.

    By key: name triplets; a format that a fast call does not read; all three kinds a keyword function reads, in their order and
    with a deprecated text; the two of a positional one; a text alone, whose only return is none; a keyword call a positional function
    does not read.
    """
    fn, kind = F.col("o_orderkey").alias("fn"), F.col("o_orderkey") % 6
    functions = t.orders.select(
        fn,
        F.col("o_orderpriority").alias("module_name"),
        F.lit(None).cast("string").alias("class_name"),
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("function_name"),
        F.when(kind.isin(0, 1), 128).when(kind.isin(2, 4), 3).otherwise(1).alias("flags"),
    )
    none = F.lit(None).cast("string")
    shown = F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.lit("(Tensor input, int64_t? dim=None, *, bool keepdim=False)"))

    def fact(at, of, fmt=none, names=None, said=none, values=None):
        listed = [(F.lit(None) if v is None else F.array(*[F.lit(x).cast("string") for x in v])).cast("array<string>") for v in (names, values)]
        return F.struct(
            F.lit(at).alias("call_pos"), F.lit(of).alias("kind"), (F.lit(fmt) if isinstance(fmt, str) else fmt).alias("fmt"),
            listed[0].alias("names"), said.alias("text"), listed[1].alias("values"),
        )

    triplets = fact(0, P.TRIPLETS, values=["", None, "&v0", "|axis", "NI_ObjectToInputArray", "&v1", "$out", None, "&v2", None, None, None])
    text_fact, old = fact(0, P.DELIMITED, said=shown), fact(3, P.DELIMITED, said=F.concat(shown, F.lit("|deprecated")))
    keywords, plain = fact(1, P.KEYWORDS, "O|i", ["a", "b"]), fact(2, P.TUPLE, "s")
    facts = (
        F.when(kind == 0, F.array(triplets)).when(kind == 1, F.array(plain)).when(kind == 2, F.array(text_fact, keywords, plain, old))
        .when(kind == 3, F.array(text_fact, keywords, plain)).when(kind == 4, F.array(text_fact)).otherwise(F.array(keywords))
    )
    calls = t.orders.select(fn, F.explode(facts).alias("c")).select("fn", "c.*")
    spread = F.when(F.col("kind") == P.TRIPLETS, 3).when(F.col("kind") == P.KEYWORDS, 2).otherwise(1)
    at = F.col("slot_index")
    slots = calls.where(F.col("kind") != P.DELIMITED).select("fn", "call_pos", "kind", F.explode(F.sequence(F.lit(0), spread - 1)).alias("slot_index"))
    slots = slots.select(
        "fn", "call_pos", "slot_index", F.concat(F.lit("v"), at.cast("string")).alias("var"),
        F.when((F.col("kind") == P.TRIPLETS) & (at == 1), F.lit("NI_ObjectToInputArray")).alias("operand"),
        F.when((F.col("kind") == P.TRIPLETS) & (at == 1), F.lit("0")).alias("default_value"),
    )
    checks = t.orders.where(kind == 0).select(fn, F.lit("v2").alias("var"), F.lit("PyUnicode_Check").alias("call_name"))
    empty = F.struct(F.lit(1).alias("pos"), F.lit("ref").alias("expr_kind"), F.lit("_Py_NoneStruct").alias("expr_name"), none.alias("expr_detail"))
    wrapped = F.struct(F.lit(2).alias("pos"), F.lit("call").alias("expr_kind"), F.lit("wrap").alias("expr_name"), F.lit("at::Tensor").alias("expr_detail"))
    made = F.struct(F.lit(2).alias("pos"), F.lit("call").alias("expr_kind"), F.lit("PyObject_New").alias("expr_name"), F.lit("&PyList_Type").alias("expr_detail"))
    odd = F.struct(F.lit(2).alias("pos"), F.lit("call").alias("expr_kind"), F.lit("unheard_of").alias("expr_name"), none.alias("expr_detail"))
    told = (
        F.when(kind == 0, F.array(made)).when(kind.isin(1, 4), F.array(empty)).when(kind.isin(2, 3), F.array(empty, wrapped)).otherwise(F.array(odd))
    )
    returns = t.orders.select(fn, F.explode(told).alias("r")).select("fn", "r.*")
    assigns = returns.limit(0).select("fn", F.lit("").alias("var"), "pos", F.col("expr_kind").alias("rhs_kind"), F.col("expr_name").alias("rhs_name"))
    done = CP.complete_functions(functions, calls, slots, checks, returns, assigns, merge_rules([rule_table(t.spark)]))
    each = done.select("function_id", "parameter_inference_status", "return_inference_status", F.explode("signatures").alias("s"))
    return each.select("function_id", "s.signature_index", "s.signature", "parameter_inference_status", "return_inference_status")


_ITEMS_SQL = """
    SELECT o_orderkey AS fn, CASE o_orderkey % 6
        WHEN 0 THEN 'tuple[int, list]' WHEN 1 THEN 'tuple[int, typing.Any]' WHEN 2 THEN 'tuple[list[int | tuple[float,]], dict[None | str, list]]'
        WHEN 3 THEN 'tuple[int, float]' WHEN 4 THEN 'tuple[list,]' ELSE 'typing.Any' END AS return_type,
        CASE WHEN o_orderkey % 6 = 5 THEN 'failed' ELSE 'success' END AS status
    FROM orders
"""


@bound("flow_object_items", _ITEMS_SQL)
def flow_items(t):
    """Orders as functions that return built values whose object items are expressions of their own.

    By key: an item created from a type object; one that cannot be inferred; formats within formats, through a variable as well; an
    item that is a variable; a variable that holds the whole format; arguments that do not match the format.
    """
    key = F.col("o_orderkey")
    kind = key % 6
    fn, none = key.alias("fn"), F.lit(None).cast("string")
    fmt = F.when(kind.isin(0, 1, 3), "(iO)").when(kind == 2, "([iO]{sO})").when(kind == 5, "(iO)")
    returns = t.orders.select(
        fn, F.lit(50).alias("pos"), F.when(kind == 4, "ref").otherwise("value_format").alias("expr_kind"),
        F.when(kind == 4, F.lit("whole")).otherwise(fmt).alias("expr_name"), F.when(kind != 4, F.lit("r")).alias("expr_id"),
    )

    def item(of, index, what="other", name="", detail=none, inner=none):
        return F.struct(
            F.lit(of).alias("expr_id"), F.lit(index).alias("item_index"), F.lit(45).alias("pos"), F.lit(what).alias("expr_kind"),
            F.lit(name).alias("expr_name"), (F.lit(detail) if isinstance(detail, str) else detail).alias("expr_detail"),
            (F.lit(inner) if isinstance(inner, str) else inner).alias("inner_id"),
        )

    created = ("call", "PyObject_New", "&PyList_Type")
    listed = (
        F.when(kind == 0, F.array(item("r", 0), item("r", 1, *created)))
        .when(kind == 1, F.array(item("r", 0), item("r", 1, "call", "unheard_of")))
        .when(
            kind == 2,
            F.array(
                item("r", 0), item("r", 1, "value_format", "(O)", inner="x"), item("r", 2), item("r", 3, "ref", "held"),
                item("x", 0, "call", "PyFloat_FromDouble"),
            ),
        )
        .when(kind == 3, F.array(item("r", 0), item("r", 1, "ref", "v")))
        .when(kind == 4, F.array(item("w", 0, *created)))
        .otherwise(F.array(item("r", 0)))
    )
    items = t.orders.select(fn, F.explode(listed).alias("i")).select("fn", "i.*")

    def assign(var, what, name, detail=none, rhs=none):
        return F.struct(
            F.lit(var).alias("var"), F.lit(5).alias("pos"), F.lit(what).alias("rhs_kind"), F.lit(name).alias("rhs_name"),
            (F.lit(detail) if isinstance(detail, str) else detail).alias("rhs_detail"), (F.lit(rhs) if isinstance(rhs, str) else rhs).alias("rhs_id"),
        )

    held = F.when(kind == 2, F.array(assign("held", *created))).when(kind == 3, F.array(assign("v", "call", "PyFloat_FromDouble")))
    assigns = t.orders.select(fn, F.explode(held.when(kind == 4, F.array(assign("whole", "value_format", "(O)", rhs="w")))).alias("a")).select("fn", "a.*")
    return CP.infer_return_types(returns, assigns, merge_rules([rule_table(t.spark)]), items)


_CHAIN_SQL = """
    SELECT o_orderpriority || ':f' || o_orderkey AS function_id,
        CASE WHEN o_orderstatus = 'P' THEN 'pybind11' ELSE 'c_extension' END AS provider,
        CASE WHEN broken OR lost THEN 'failed' ELSE 'success' END AS mapping_status,
        CASE WHEN broken OR lost OR o_orderstatus = 'O' THEN 'failed' ELSE 'success' END AS parameter_inference_status,
        CASE WHEN broken THEN 'argument without type' WHEN lost THEN 'definition not found'
             WHEN o_orderstatus = 'O' THEN 'parameters were not inferred' END AS failure_reason,
        CASE WHEN broken OR lost OR o_orderstatus = 'O' THEN 1 WHEN o_orderstatus = 'P' AND o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS n_signatures
    FROM (SELECT *, o_orderstatus = 'P' AND o_orderkey % 3 = 0 AS broken, o_orderstatus <> 'P' AND c_mktsegment = 'BUILDING' AS lost
          FROM orders JOIN customer ON o_custkey = c_custkey)
    WHERE NOT (o_orderpriority = '5-LOW' AND o_orderkey % 7 = 0)
      AND (CASE WHEN o_orderstatus = 'P' THEN o_orderkey % 2 = 0 ELSE c_acctbal >= 0 END)
"""


def provider_chain(t):
    """Orders as module functions; each has a range and a definition of its own, by what its customer is.

    Some members come from elsewhere, some handles are of no known kind, some addresses lie in no range, some definitions are
    missing, some have no parse call, and some overload texts do not parse.
    """
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    name = F.concat(F.lit("f"), key.cast("string"))
    foreign = (F.col("o_orderpriority") == "5-LOW") & (key % 7 == 0)
    no = F.lit(False)
    customers = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment")
    # Members, ranges, definitions and texts all read these rows, so they are joined once.
    fields = ["o_orderkey", "o_orderpriority", "o_orderstatus", "c_acctbal", "c_mktsegment"]
    orders = sized(t.orders.join(customers, "o_custkey").select(*fields), "members")
    members = orders.select(
        key.alias("fn"), F.col("o_orderpriority").alias("module_name"), F.lit(None).cast("string").alias("class_name"),
        name.alias("function_name"), F.when(foreign, F.lit("other")).otherwise(F.col("o_orderpriority")).alias("defined_in"),
        F.lit(True).alias("is_callable"), ((status != "P") | (key % 2 == 0)).alias("builtin"), (status == "P").alias("bound_to_pybind"),
        no.alias("method_descriptor"), no.alias("class_method_descriptor"), no.alias("instance_method"), no.alias("static_wrapper"),
        F.lit("lib").alias("binary"), (key * 16 + key % 16).alias("address"),
    )
    symbol = F.concat(F.lit("_Z"), key.cast("string")).alias("linkage_name")
    ranges = orders.where(F.col("c_acctbal") >= 0).select(
        F.lit("lib").alias("binary"), (key * 16).alias("low_pc"), (key * 16 + 16).alias("high_pc"), F.lit(1).alias("depth"),
        symbol, name.alias("function_name"),
    )
    by_linkage = orders.where(F.col("c_mktsegment") != "BUILDING").select(F.lit("lib").alias("binary"), symbol, key.alias("definition"))
    by_name = by_linkage.select("binary", F.col("linkage_name").alias("function_name"), "definition").limit(0)
    second = F.when(key % 3 == 0, F.lit("(y) -> int")).when(key % 5 == 0, F.lit("(y: str = 'a') -> int"))
    texts = orders.where(status == "P").select(
        key.alias("fn"), F.posexplode(F.filter(F.array(F.lit("(x: int) -> str"), second), lambda x: x.isNotNull())).alias("position", "text")
    )
    return members, texts, ranges, by_linkage, by_name


def chain_records(t):
    """The chain over facts per order: finished ones take no arguments, open ones have no parse call."""
    members, texts, ranges, by_linkage, by_name = provider_chain(t)
    fn, status = F.col("o_orderkey").alias("fn"), F.col("o_orderstatus")
    functions = t.orders.where(status != "P").select(
        fn, F.col("o_orderpriority").alias("module_name"), F.lit(None).cast("string").alias("class_name"),
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("function_name"), F.when(status == "F", 4).otherwise(1).alias("flags"),
    )
    none = functions.limit(0)
    text_, number = F.lit("").alias, F.lit(0).alias
    calls = none.select("fn", number("call_pos"), text_("fmt"))
    slots = none.select("fn", number("call_pos"), number("slot_index"), text_("var"), text_("operand"), text_("default_value"))
    checks = none.select("fn", text_("var"), text_("call_name"))
    returns = functions.select("fn", F.lit(1).alias("pos"), F.lit("call").alias("expr_kind"), F.lit("PyLong_FromLong").alias("expr_name"))
    assigns = none.select("fn", text_("var"), number("pos"), text_("rhs_kind"), text_("rhs_name"))
    done = CP.complete_functions(functions, calls, slots, checks, returns, assigns, merge_rules([rule_table(t.spark)]))
    done = done.withColumn("definition", F.split_part("function_id", F.lit(":f"), F.lit(2)).cast("bigint"))
    return PV.complete_chain(members, done, texts, ranges, by_linkage, by_name)


@bound("flow_provider_chain", _CHAIN_SQL)
def flow_chain(t):
    return chain_records(t).select(
        "function_id", "provider", "mapping_status", "parameter_inference_status", "failure_reason",
        F.size("signatures").alias("n_signatures"),
    )


_LIVE_SQL = f"""
    WITH l AS (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER_SQL}, l_linestatus, l_returnflag) - 1 AS i
        FROM lineitem),
    a AS (
        SELECT l_orderkey, count(*) AS n, string_agg('    ' || CASE l_returnflag WHEN 'R' THEN 'v' || i || ': str'
            WHEN 'A' THEN 'v' || i || ': int'
            ELSE 'v' || i || ': ' || CASE WHEN l_linestatus = 'F' THEN 'list' WHEN l_linenumber % 2 = 0 THEN 'str' ELSE 'object' END
            END || ',' || chr(10), '' ORDER BY i) AS args
        FROM l GROUP BY 1),
    f AS (
        SELECT *, 'def f' || o_orderkey AS head, o_orderstatus = 'P' AS p,
            o_orderstatus = 'P' AND o_orderkey % 3 = 0 AS broken,
            o_orderstatus <> 'P' AND (c_mktsegment = 'BUILDING' OR o_orderkey % 4 = 1) AS lost,
            CASE WHEN o_orderstatus = 'O' THEN 'int' WHEN o_totalprice > 250000 THEN 'None' ELSE 'float' END AS ret
        FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN a ON l_orderkey = o_orderkey
        WHERE NOT (o_orderpriority = '5-LOW' AND o_orderkey % 7 = 0)
          AND (CASE WHEN o_orderstatus = 'P' THEN o_orderkey % 2 = 0 ELSE c_acctbal >= 0 END))
    SELECT o_orderpriority || ':f' || o_orderkey AS function_id, CASE WHEN p THEN 'pybind11' ELSE 'c_extension' END AS provider,
        CASE WHEN broken OR lost THEN 'failed' ELSE 'success' END AS mapping_status,
        CASE WHEN broken OR lost OR (NOT p AND n IS NULL) THEN 'failed' ELSE 'success' END AS parameter_inference_status,
        CASE WHEN broken THEN 'argument without type' WHEN lost THEN 'definition not found'
             WHEN NOT p AND n IS NULL THEN 'parameters were not inferred' END AS failure_reason,
        CASE WHEN broken OR lost OR (NOT p AND n IS NULL) THEN head || '{PV.MINIMAL}:' WHEN p THEN head || '(x: int) -> str:'
             WHEN n = 1 THEN head || '(' || substr(args, 5, length(args) - 6) || ', /) -> ' || ret || ':'
             ELSE head || '(' || chr(10) || args || '    /,' || chr(10) || ') -> ' || ret || ':' END AS signature
    FROM f
"""


@bound("flow_chain_live", _LIVE_SQL)
def flow_chain_live(t):
    """The chain over facts from orders and lines in which every branch sees rows.

    Parse calls, slots, checks, returns and assignments are those of the completion flow. Every fourth range has no linkage name and is
    found by function name; every fourth has one that no definition carries, and is not looked for by its function name.
    """
    members, texts, ranges, by_linkage, _ = provider_chain(t)
    key = F.col("definition")
    ranges = ranges.withColumn("linkage_name", F.when(F.col("low_pc") / 16 % 4 != 0, F.col("linkage_name")))
    named = F.concat(F.lit("f"), key.cast("string")).alias("function_name")
    by_name = by_linkage.where((key % 4).isin(0, 1)).select("binary", named, "definition")
    by_linkage = by_linkage.where(~(key % 4).isin(0, 1))
    functions, calls, slots, checks, returns, assigns = call_facts(t)
    open_ = t.orders.where(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("fn"))
    functions = functions.join(open_, "fn", "left_semi").withColumn("class_name", F.lit(None).cast("string"))
    done = CP.complete_functions(functions, calls, slots, checks, returns, assigns, _default_rules(t))
    done = done.withColumn("definition", F.split_part("function_id", F.lit(":f"), F.lit(2)).cast("bigint"))
    records = PV.complete_chain(members, done, texts, ranges, by_linkage, by_name)
    return records.select(
        "function_id", "provider", "mapping_status", "parameter_inference_status", "failure_reason", F.get("signatures", F.lit(0))["signature"].alias("signature")
    )


@bound(
    "flow_chain_funnel",
    f"""
    SELECT provider, count(*) AS total_functions, count(*) FILTER (WHERE mapping_status = 'success') AS mapping_success,
           round(count(*) FILTER (WHERE mapping_status = 'success') * 100.0 / count(*), 6)::DOUBLE AS mapping_rate
    FROM ({_CHAIN_SQL}) GROUP BY 1
    """,
)
def flow_chain_funnel(t):
    return funnel(chain_records(t), ["provider"]).select(
        "provider", "total_functions", "mapping_success", F.round("mapping_rate", 6).alias("mapping_rate")
    )


@bound(
    "tx12_module_lines",
    """
    WITH f AS (
        SELECT r_name AS module, c_custkey AS k, unnest(range(CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END)) AS i
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    lines AS (
        SELECT module, '    def f' || k || '() -> int:' AS line FROM f
        UNION ALL SELECT module, '        ...' FROM f
        UNION ALL SELECT module, '    @typing.overload' FROM f WHERE k % 2 = 0
        UNION ALL SELECT DISTINCT module, 'import typing' FROM f
        UNION ALL SELECT r_name, 'class S' || n_nationkey || ':' FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT r_name, '    pass' FROM nation JOIN region ON n_regionkey = r_regionkey
            WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer))
    SELECT module, line, count(*) AS n_lines FROM lines GROUP BY 1, 2
    """,
)
def module_texts(t):
    """Regions as modules, nations as classes, customers as their methods; every other one is overloaded."""
    text_type, none = "string", F.lit(None).cast("string")
    module = F.concat(F.lit("r"), F.col("r_regionkey").cast(text_type))
    owner = F.concat(F.lit("n"), F.col("n_nationkey").cast(text_type))
    method = F.concat(F.lit("c"), F.col("c_custkey").cast(text_type))
    bases = F.array().cast("array<string>").alias("bases")

    def nodes_of(df, node, parent, kind, name):
        return df.select(node.alias("node_id"), parent.alias("parent_id"), F.lit(kind).alias("kind"), name.alias("name"), none.alias("doc"), bases)

    nation = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    customer = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    nodes = (
        nodes_of(t.region, module, none, "module", F.col("r_name"))
        .unionByName(nodes_of(nation, owner, module, "class", F.concat(F.lit("S"), F.col("n_nationkey").cast(text_type))))
        .unionByName(nodes_of(customer, method, owner, "function", F.concat(F.lit("f"), F.col("c_custkey").cast(text_type))))
    )
    indexes = F.sequence(F.lit(0), F.when(F.col("c_custkey") % 2 == 0, 1).otherwise(0))
    signatures = t.customer.select(
        method.alias("node_id"), F.explode(indexes).alias("signature_index"), F.array().cast(f"array<{S.ARGUMENT}>").alias("args"),
        F.lit("int").alias("return_type"), F.array(F.lit("typing")).alias("imports"), none.alias("decorator"),
    )
    return RN.module_lines(nodes, signatures).groupBy("module", "line").agg(F.count(F.lit(1)).alias("n_lines"))


@bound("flow_evaluate_signatures", _EVALUATED_SQL)
def flow_evaluate(t):
    _, rows = evaluated(t)
    return rows.select("function_id", "signature_index", "parameter_type_code", "return_type_code", "reference_kind", "status")


@bound(
    "flow_evaluation_report",
    f"""
    SELECT count(*) AS total_signatures, count(*) FILTER (WHERE status = 'ok') AS evaluated_rows,
           count(*) FILTER (WHERE status <> 'ok') AS error_rows,
           count(*) FILTER (WHERE status = 'ok' AND parameter_type_code = 'rule_unqualified') AS parameter_type_rule_unqualified_count,
           count(*) FILTER (WHERE status = 'ok' AND return_type_code = 'qualified') AS return_type_qualified_count
    FROM ({_EVALUATED_SQL})
    """,
)
def flow_report(t):
    functions, rows = evaluated(t)
    return evaluation_summary(functions, EV.checked_codes(rows), status="status").select(
        "total_signatures", "evaluated_rows", "error_rows", "parameter_type_rule_unqualified_count", "return_type_qualified_count"
    )


@bound(
    "flow_completion_funnel",
    f"""
    SELECT count(*) AS total_functions, count(*) AS mapping_success,
           count(*) FILTER (WHERE parameter_inference_status = 'success') AS parameter_success,
           round(count(*) FILTER (WHERE parameter_inference_status = 'success') * 100.0 / count(*), 6)::DOUBLE AS parameter_rate
    FROM ({_COMPLETED_SQL})
    """,
)
def flow_funnel(t):
    return funnel(completed(t)).select(
        "total_functions", "mapping_success", "parameter_success", F.round("parameter_rate", 6).alias("parameter_rate")
    )
