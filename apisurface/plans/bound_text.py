"""Text and nested functions on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from apisurface import schemas as S
from apisurface.functions import formats as FM
from apisurface.functions import signatures as SG
from apisurface.functions import text as X
from apisurface.functions.render import function_lines, render_signature
from apisurface.functions.types import evaluate_once, union_of_texts
from apisurface.functions.verdicts import DEFAULT_INSTRUCTIONS, DEFAULT_SYSTEM, build_messages, parse_verdict
from apisurface.plans.registry import LINE_ORDER, LINE_ORDER_SQL, bound, ordered_lines, spread, text


def _text_of(array, fn, sep):
    return F.array_join(F.transform(array, fn), sep)


@bound(
    "tx1_parse_repo_url",
    """
    SELECT page_id, CASE WHEN contains(url, 'example.com') AND rest <> '' THEN split_part(rest, '/', 1) END AS owner,
           CASE WHEN contains(url, 'example.com') AND rest <> ''
                THEN regexp_extract(split_part(rest, '/', 2), '^[^?#]+') END AS repo
    FROM (SELECT page_id, url, regexp_extract(url, 'example\\.com/([^/]+/[^/?#]+)', 1) AS rest FROM pages)
    """,
)
def tx1(t):
    repo = X.parse_repo_url("url", host="example.com")
    return t.pages.select("page_id", repo.alias("r")).select("page_id", "r.owner", "r.repo")


@bound(
    "tx2_pick_url",
    """
    SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN n_name ELSE r_name END AS owner,
           CASE WHEN n_regionkey = 1 THEN 'code' ELSE n_name END AS repo
    FROM nation JOIN region ON n_regionkey = r_regionkey
    """,
)
def tx2(t):
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    base = F.lit("https://github.com/")
    code = F.when(F.col("n_regionkey") == 1, F.concat(base, "n_name", F.lit("/code?x=1"))).otherwise(
        F.lit("https://gitlab.example/x/y")
    )
    urls = F.create_map(
        F.lit("Docs"), F.concat(base, "r_name", F.lit("/"), "n_name", F.lit(".git")), F.lit("Code"), code
    )
    return joined.select("n_nationkey", X.pick_url(urls).alias("r")).select("n_nationkey", "r.owner", "r.repo")


@bound(
    "tx3_first_identifier",
    r"""
    SELECT event_id, nullif(regexp_extract(props, '\b[_A-Za-z]\w*\b'), '') AS name, event_type AS object
    FROM events
    """,
)
def tx3(t):
    operand = F.concat(F.lit(" & "), "event_type", F.lit(" "))
    return t.events.select(
        "event_id", X.first_identifier("props").alias("name"), X.type_object_name(operand).alias("object")
    )


_SPACES = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@bound(
    "tx4_normalize_type",
    rf"""
    SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        trim(regexp_replace(text, '{_SPACES}+', ' ', 'g'), ' '), '\bconst +', '', 'g'), ' *([<>,*&]) *', '\1', 'g'), '&$', ''), '&$', '')) AS digest
    FROM documents
    """,
)
def tx4(t):
    return spread(t.documents.select("doc_id", "text")).select("doc_id", F.md5(X.normalize_type("text")).alias("digest"))


@bound(
    "tx4_cpp_return_type",
    """
    SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 'torch.Tensor' WHEN p_type = 'LARGE' THEN 'tuple[int, ...]' END AS type
    FROM part
    """,
)
def tx4_cpp(t):
    cpp = (
        F.when(F.col("p_type") == "SMALL", F.lit("const  at::Tensor &"))
        .when(F.col("p_type") == "LARGE", F.lit("c10::ArrayRef< long   long > &&"))
        .otherwise(F.col("p_name"))
    )
    return t.part.select("p_partkey", X.cpp_return_type(cpp).alias("type"))


def order_formats(t):
    """Argument format of each order: one unit per line in line order."""
    lines = ordered_lines(t, "l_returnflag")
    unit = lambda x: F.when(x["l_returnflag"] == "A", "i").when(x["l_returnflag"] == "N", "O!").otherwise("es#")
    return lines.select("l_orderkey", F.array_join(F.transform("lines", unit), "").alias("fmt"))


@bound(
    "tx5_tokenize_format",
    f"""
    SELECT l_orderkey, count(*) AS tokens,
           sum(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END)::BIGINT AS slots,
           string_agg(CASE l_returnflag WHEN 'A' THEN 'int' WHEN 'N' THEN 'object' ELSE 'str' END, ','
                      ORDER BY {LINE_ORDER_SQL}, l_returnflag) AS types
    FROM lineitem GROUP BY 1
    """,
)
def tx5(t):
    tokens = order_formats(t).select("l_orderkey", FM.tokenize_format(F.concat("fmt", F.lit(":named"))).alias("tokens"))
    return tokens.select(
        "l_orderkey",
        F.size("tokens").cast("bigint").alias("tokens"),
        F.aggregate("tokens", F.lit(0), lambda n, x: n + x["slots"]).cast("bigint").alias("slots"),
        _text_of("tokens", lambda x: x["type"], ",").alias("types"),
    )


@bound(
    "tx6_check_format",
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '$ needs keyword parsing'
                            WHEN o_orderpriority = '5-LOW' THEN 'arguments do not match units' END AS error
    FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
    """,
)
def tx6(t):
    flags = t.lineitem.groupBy("l_orderkey").agg(
        F.sum(F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)).cast("int").alias("slots")
    )
    rows = order_formats(t).join(flags, "l_orderkey").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    optional = F.col("o_orderstatus") == "O"
    fmt = F.when(optional, F.concat("fmt", F.lit("|(id)"))).when(
        F.col("o_orderstatus") == "P", F.concat("fmt", F.lit("$i"))
    ).otherwise(F.col("fmt"))
    slots = F.col("slots") + F.when(optional, 2).otherwise(0) + F.when(F.col("o_orderpriority") == "5-LOW", 1).otherwise(0)
    return rows.select("o_orderkey", FM.check_format(fmt, slots).alias("error"))


@bound(
    "tx6_check_keywords",
    """
    SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'repeated |' WHEN 'SMALL' THEN '| after $' WHEN 'PROMO' THEN '$ before |'
        WHEN 'LARGE' THEN 'names do not match units' WHEN 'MEDIUM' THEN 'empty name after a named keyword' END AS error
    FROM part
    """,
)
def tx6_keywords(t):
    kind = F.col("p_type")
    fmt = (
        F.when(kind == "ECONOMY", "i|s|d").when(kind == "SMALL", "i|s$d|").when(kind == "PROMO", "is$d").otherwise("i|s$d")
    )
    names = F.when(kind == "LARGE", F.array(F.lit("a"), F.lit("b"))).when(
        kind == "MEDIUM", F.array(F.lit("a"), F.lit(""), F.lit("c"))
    ).otherwise(F.array(F.lit(""), F.lit("b"), F.col("p_name")))
    return t.part.select("p_partkey", FM.check_format(fmt, F.lit(3), names).alias("error"))


@bound(
    "tx7_value_format_type",
    f"""
    WITH lines AS (
        SELECT l_orderkey, count(*) AS n,
            string_agg(CASE l_returnflag WHEN 'A' THEN 'int' WHEN 'N' THEN 'None | str' ELSE 'float' END, ', '
                       ORDER BY {LINE_ORDER_SQL}, l_returnflag) AS items,
            array_to_string(list_sort(list_distinct(flatten(list(
                CASE l_returnflag WHEN 'A' THEN ['int'] WHEN 'N' THEN ['None', 'str'] ELSE ['float'] END)))), ' | ') AS members
        FROM lineitem GROUP BY 1)
    SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'list[' || members || ']' WHEN 'P' THEN 'dict[None | str, ' || members || ']'
        ELSE CASE WHEN n = 1 THEN 'tuple[' || items || ',]' ELSE 'tuple[' || items || ']' END END AS type
    FROM orders JOIN lines ON l_orderkey = o_orderkey
    """,
)
def tx7(t):
    status = F.col("o_orderstatus")

    def joined(before):
        unit = lambda x: F.concat(
            F.lit(before), F.when(x["l_returnflag"] == "A", "i").when(x["l_returnflag"] == "N", "s#").otherwise("d")
        )
        return F.array_join(F.transform("lines", unit), "")

    rows = ordered_lines(t, "l_returnflag").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    fmt = (
        F.when(status == "O", F.concat(F.lit("["), joined(""), F.lit("]")))
        .when(status == "P", F.concat(F.lit("{"), joined("s:"), F.lit("}")))
        .otherwise(F.concat(F.lit("("), joined(","), F.lit(")")))
    )
    return rows.select("o_orderkey", FM.value_format_type(fmt)["type"].alias("type"))


_PART_NAME = "replace(p_name, ' ', '_')"


@bound(
    "tx8_parse_overload",
    f"""
    SELECT p_partkey, 'self,size,' || {_PART_NAME} AS names, p_brand || ',dict[int, str],str' AS types,
           '-;' || chr(123) || '1: "a,b"' || chr(125) || ';"' || p_name || '"' AS defaults,
           'POSITIONAL_ONLY,POSITIONAL_OR_KEYWORD,KEYWORD_ONLY' AS kinds, p_type AS return_type, NULL::VARCHAR AS error
    FROM part WHERE p_type <> 'PROMO'
    UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, 'argument without type' FROM part WHERE p_type = 'PROMO'
    """,
)
def tx8(t):
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    annotated = F.when(F.col("p_type") == "PROMO", F.lit("")).otherwise(F.lit(": dict[int, str]"))
    source = F.concat(
        F.lit("(self: "), "p_brand", F.lit(", /, size"), annotated, F.lit(' = {1: "a,b"}, *, '), name,
        F.lit(': str = "'), "p_name", F.lit('") -> '), "p_type",
    )
    told = spread(t.part.select("p_partkey", source.alias("source")))
    parsed = evaluate_once(told, "p", SG.parse_overload("source"))
    return parsed.select(
        "p_partkey",
        _text_of("p.args", lambda a: a["name"], ",").alias("names"),
        _text_of("p.args", lambda a: a["type"], ",").alias("types"),
        _text_of("p.args", lambda a: F.coalesce(a["default_value"], F.lit("-")), ";").alias("defaults"),
        _text_of("p.args", lambda a: a["kind"], ",").alias("kinds"),
        "p.return_type",
        "p.error",
    )


@bound(
    "tx9_parse_delimited_signature",
    """
    SELECT p_partkey, 'size' AS name, p_type AS type, CAST(p_size AS VARCHAR) AS default_value, 'POSITIONAL_OR_KEYWORD' AS kind FROM part
    UNION ALL SELECT p_partkey, 'price', CASE WHEN p_brand < 'None' THEN p_brand || ' | None' ELSE 'None | ' || p_brand END, NULL, 'KEYWORD_ONLY' FROM part
    UNION ALL SELECT p_partkey, 'out', 'None | torch.Tensor', 'None', 'KEYWORD_ONLY' FROM part
    """,
)
def tx9(t):
    source = F.concat(
        F.lit("f("), "p_type", F.lit("[2] size="), F.col("p_size").cast("string"), F.lit(", *, "), "p_brand",
        F.lit("? price, Tensor out=None)"),
    )
    told = spread(t.part.select("p_partkey", source.alias("source")))
    parsed = evaluate_once(told, "p", SG.parse_delimited_signature("source"))
    parsed = parsed.select("p_partkey", F.explode("p.args").alias("a"))
    return parsed.select("p_partkey", "a.name", "a.type", "a.default_value", "a.kind")


@bound(
    "tx10_parse_name_spec",
    """
    SELECT event_id, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS name,
        CASE event_type WHEN 'error' THEN 'KEYWORD_ONLY' WHEN 'view' THEN 'POSITIONAL_ONLY' ELSE 'POSITIONAL_OR_KEYWORD' END AS kind,
        CASE WHEN event_type IN ('error', 'click', 'view') THEN 'true' ELSE 'false' END AS optional
    FROM events
    """,
)
def tx10(t):
    kind = F.col("event_type")
    spec = (
        F.when(kind == "error", F.concat(F.lit("$"), kind))
        .when(kind == "click", F.concat(F.lit("|"), kind))
        .when(kind == "view", F.lit("|"))
        .otherwise(kind)
    )
    parsed = t.events.select("event_id", SG.parse_name_spec(spec).alias("s"))
    return parsed.select("event_id", "s.name", "s.kind", text(F.col("s.optional")).alias("optional"))


@bound(
    "tx10_name_triplets",
    """
    SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN NULL WHEN p_type = 'SMALL' THEN 'slot_' || p_size ELSE p_brand END AS name,
           CASE WHEN p_type = 'PROMO' THEN 'length is not a multiple of three' END AS error
    FROM part
    """,
)
def tx10_triplets(t):
    none = F.lit(None).cast("string")
    name = F.when(F.col("p_type") == "SMALL", F.lit("|")).otherwise(F.col("p_brand"))
    full = F.array(name, F.col("p_name"), F.concat(F.lit("slot_"), F.col("p_size").cast("string")), none, none, none)
    values = F.when(F.col("p_type") == "PROMO", F.slice(full, 1, 4)).otherwise(full)
    parsed = t.part.select("p_partkey", SG.parse_name_triplets(values).alias("p"))
    return parsed.select("p_partkey", _text_of("p.items", lambda i: i["name"], ",").alias("name"), "p.error")


@bound(
    "tx11_leading_blanks",
    f"""
    WITH n AS (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER_SQL}, l_returnflag) AS i
               FROM lineitem),
    f AS (SELECT l_orderkey, min(CASE WHEN l_returnflag <> 'R' THEN i END) AS first_named,
                 max(CASE WHEN l_returnflag = 'R' THEN i END) AS last_blank, count(*) AS n FROM n GROUP BY 1)
    SELECT l_orderkey, CAST(coalesce(first_named - 1, n) AS INTEGER) AS blanks,
           CASE WHEN last_blank > first_named THEN 'empty name after a named keyword' END AS error
    FROM f
    """,
)
def tx11(t):
    names = F.transform("lines", lambda x: F.when(x["l_returnflag"] == "R", F.lit("")).otherwise(x["l_returnflag"]))
    counted = ordered_lines(t, "l_returnflag").select("l_orderkey", FM.leading_blanks(names).alias("b"))
    return counted.select("l_orderkey", F.col("b.count").alias("blanks"), "b.error")


def _args(*specs):
    fields = ("name", "type", "default_value", "kind")
    return F.array(*[F.struct(*[v.alias(f) for f, v in zip(fields, spec)]) for spec in specs])


@bound(
    "tx12_render_signature",
    """
    SELECT p_partkey, '@staticmethod' || chr(10) || CASE WHEN p_type = 'SMALL' THEN '@typing.overload' || chr(10) ELSE '' END
        || 'def f(' || chr(10) || '    name: ' || p_brand || ',' || chr(10)
        || CASE WHEN p_type = 'PROMO' THEN '    *args,' || chr(10) ELSE '    /,' || chr(10) || '    *,' || chr(10) END
        || '    size: int = ' || p_size || ',' || chr(10) || ') -> ' || p_type || ':' || chr(10) || '    ...' AS text,
        'def g(a: ' || p_type || '):' AS short
    FROM part
    """,
)
def tx12(t):
    none = F.lit(None).cast("string")
    promo = F.col("p_type") == "PROMO"
    name = (F.lit("name"), F.col("p_brand"), none, F.when(promo, S.POSITIONAL_OR_KEYWORD).otherwise(S.POSITIONAL_ONLY))
    size = (F.lit("size"), F.lit("int"), F.col("p_size").cast("string"), F.lit(S.KEYWORD_ONLY))
    args = F.when(promo, _args(name, (F.lit("args"), none, none, F.lit(S.VAR_POSITIONAL)), size)).otherwise(_args(name, size))
    lines = function_lines(F.lit("f"), args, "p_type", F.col("p_type") == "SMALL", F.lit("staticmethod"))
    one = _args((F.lit("a"), F.col("p_type"), none, F.lit(S.POSITIONAL_OR_KEYWORD)))
    return t.part.select(
        "p_partkey", F.array_join(lines, "\n").alias("text"), render_signature(F.lit("g"), one, none).alias("short")
    )


@bound(
    "tx13_escape_doc",
    """
    SELECT conv_id, turn, md5(replace(replace(text, chr(92), chr(92) || chr(92)), '\"\"\"',
                                      chr(92) || '\"' || chr(92) || '\"' || chr(92) || '\"')) AS digest
    FROM conversations
    """,
)
def tx13(t):
    return t.conversations.select("conv_id", "turn", F.md5(X.escape_doc("text")).alias("digest"))


@bound(
    "tx14_slice_source",
    r"""
    SELECT doc_id, CASE WHEN lang = 'es' OR length(ascii) < 5 THEN NULL ELSE substr(ascii, 4, length(ascii) - 5) END AS text,
           CASE WHEN lang = 'es' OR length(ascii) < 5 THEN 'range ends before it starts' END AS error
    FROM (SELECT doc_id, lang, regexp_replace(text, '[^\x00-\x7f]', '?', 'g') AS ascii FROM documents)
    """,
)
def tx14(t):
    plain = F.regexp_replace("text", "[^\\x00-\\x7f]", "?")
    rows = t.documents.select("doc_id", "lang", plain.cast("binary").alias("data"))
    end = F.when(F.col("lang") == "es", F.lit(2)).otherwise(F.octet_length("data") - 2)
    sliced = rows.select("doc_id", X.slice_source("data", F.lit(3), end).alias("s"))
    return sliced.select("doc_id", "s.text", "s.error")


@bound(
    "tx15_render_default",
    """
    SELECT event_id, CASE event_type WHEN 'click' THEN CAST(value AS VARCHAR) WHEN 'view' THEN CAST(9007199254740993 + CAST(floor(value) AS BIGINT) AS VARCHAR)
        WHEN 'error' THEN CASE WHEN value < 50 THEN 'True' ELSE 'False' END WHEN 'signup' THEN '''' || props || '''' ELSE '...' END AS default_value
    FROM events
    """,
)
def tx15(t):
    kind = F.col("event_type")
    rows = t.events.select(
        "event_id",
        F.when(kind == "click", "float").when(kind == "view", "integer").when(kind == "error", "bool")
        .when(kind == "signup", "string").otherwise("null").alias("k"),
        (kind == "purchase").alias("p"),
        F.when(kind == "click", "float").when(kind == "view", "int").when(kind == "error", "bool").otherwise("object").alias("e"),
        F.col("props").alias("t"),
        F.when(kind == "view", (F.floor("value") + F.lit(9007199254740993)).cast("string"))
        .when(kind == "error", F.when(F.col("value") < 50, "1").otherwise("0"))
        .otherwise(F.col("value").cast("string")).alias("n"),
    )
    return rows.select("event_id", X.render_default("k", "p", "e", "t", "n")["default_value"].alias("default_value"))


@bound(
    "tx16_join_path",
    """
    SELECT page_id, CASE WHEN contains(url, '/fr/') THEN '/abs/' || page_id
                         ELSE rtrim(split_part(url, '/', 3), '/') || '/' || split_part(url, '/', 4) END AS path
    FROM pages
    """,
)
def tx16(t):
    host = F.split_part("url", F.lit("/"), F.lit(3))
    name = F.when(
        F.contains("url", F.lit("/fr/")), F.concat(F.lit("/abs/"), F.col("page_id").cast("string"))
    ).otherwise(F.split_part("url", F.lit("/"), F.lit(4)))
    return t.pages.select("page_id", X.join_path(host, name).alias("path"))


@bound(
    "tx17_parse_verdict",
    """
    SELECT doc_id, CASE WHEN quality = 1 THEN 'qualified' ELSE 'unqualified' END AS code,
           CASE WHEN toxic = 1 THEN 'illegal parameter_type_code' WHEN quality <> 1 THEN 'return_type_reason is empty' END AS error
    FROM labels
    """,
)
def tx17(t):
    answer = F.to_json(
        F.struct(
            F.when(F.col("quality") == 1, F.lit(" qualified ")).otherwise(F.lit("unqualified")).alias("parameter_structure_code"),
            F.lit("because").alias("parameter_structure_reason"),
            F.when(F.col("toxic") == 1, F.lit("maybe")).otherwise(F.lit("qualified")).alias("parameter_type_code"),
            F.lit("因为").alias("parameter_type_reason"),
            F.lit("qualified").alias("return_type_code"),
            F.when(F.col("quality") == 1, F.lit("ok")).otherwise(F.lit("  ")).alias("return_type_reason"),
        )
    )
    parsed = t.labels.select("doc_id", parse_verdict(answer).alias("v"))
    return parsed.select("doc_id", F.col("v.parameter_structure_code").alias("code"), "v.error")


@bound(
    "tx17_rejected_answers",
    """
    SELECT event_id, CASE WHEN event_type = 'view' THEN 'not a JSON object' ELSE 'parameter_structure_code is not text' END AS error
    FROM events
    """,
)
def tx17_rejected(t):
    answer = F.when(F.col("event_type") == "view", F.expr("substring(props, 2)")).otherwise(F.col("props"))
    return t.events.select("event_id", parse_verdict(answer)["error"].alias("error"))


@bound(
    "tx18_build_messages",
    f"""
    SELECT d.doc_id, 'system,user' AS roles, '{DEFAULT_SYSTEM}' AS system_text,
        'lang: ' || lang || chr(10) || 'chars: ' || n_chars || chr(10) || 'reference kind: ' || k || chr(10) || 'instruction: '
        || CASE WHEN k = 'manual_stub' THEN '{DEFAULT_INSTRUCTIONS["manual_stub"]}'
                ELSE '{DEFAULT_INSTRUCTIONS["signature_evidence"]}' END AS user_text
    FROM (SELECT d.*, CASE WHEN l.doc_id IS NULL THEN 'signature_evidence' ELSE 'manual_stub' END AS k
          FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) d
    """,
)
def tx18(t):
    joined = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id", "left")
    kind = F.when(F.col("quality").isNull(), F.lit("signature_evidence")).otherwise(F.lit("manual_stub"))
    built = joined.select("doc_id", build_messages({"lang": "lang", "chars": "n_chars"}, kind).alias("m"))
    return built.select(
        "doc_id", _text_of("m", lambda m: m["role"], ",").alias("roles"),
        F.col("m")[0]["content"].alias("system_text"), F.col("m")[1]["content"].alias("user_text"),
    )


@bound(
    "tx18_conversation_messages",
    """
    SELECT conv_id, string_agg(role || '=' || text, ' ' ORDER BY turn) AS messages FROM conversations GROUP BY 1
    """,
)
def tx18_conversations(t):
    message = F.struct("turn", "role", "text")
    grouped = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("m"))
    shown = _text_of("m", lambda m: F.concat(m["role"], F.lit("="), m["text"]), " ")
    return grouped.select("conv_id", shown.alias("messages"))


@bound(
    "ud2_parse_format_arguments",
    f"""
    SELECT l_orderkey, string_agg(CASE l_returnflag WHEN 'A' THEN 'int' WHEN 'R' THEN 'str'
                                       WHEN 'N' THEN CASE WHEN l_linestatus = 'F' THEN 'list' ELSE 'object' END END
                                  || '=' || CASE l_returnflag WHEN 'A' THEN CAST(l_linenumber AS VARCHAR) ELSE '...' END, ' '
                                  ORDER BY {LINE_ORDER_SQL}, l_linestatus, l_returnflag) AS args
    FROM lineitem GROUP BY 1
    """,
)
def ud2(t):
    lines = ordered_lines(t, "l_linestatus", "l_returnflag")
    none = F.lit(None).cast("string")

    def slot(name, type_text=none, default=none):
        return F.struct(
            F.lit(name).alias("name"), type_text.alias("type"), none.alias("refined"), default.alias("default_value")
        )

    def slots(x):
        operand = F.when(x["l_linestatus"] == "F", F.lit("list"))
        return (
            F.when(x["l_returnflag"] == "A", F.array(slot("a", default=x["l_linenumber"].cast("string"))))
            .when(x["l_returnflag"] == "N", F.array(slot("t", operand), slot("o")))
            .otherwise(F.array(slot("e"), slot("s"), slot("n")))
        )

    unit = lambda x: F.when(x["l_returnflag"] == "A", "i").when(x["l_returnflag"] == "N", "O!").otherwise("es#")
    fmt = F.concat(F.lit("|"), F.array_join(F.transform("lines", unit), ""))
    parsed = lines.select("l_orderkey", FM.parse_format_arguments(fmt, F.flatten(F.transform("lines", slots))).alias("p"))
    return parsed.select(
        "l_orderkey", _text_of("p.args", lambda a: F.concat(a["type"], F.lit("="), a["default_value"]), " ").alias("args")
    )


@bound(
    "ag7_union_of_texts",
    f"""
    SELECT l_orderkey, array_to_string(list_sort(list_distinct(flatten(list(
        CASE l_returnflag WHEN 'A' THEN ['None', 'tuple[int | str, ...]'] WHEN 'N' THEN ['str'] ELSE ['float', 'int'] END)))), ' | ') AS type
    FROM lineitem GROUP BY 1
    """,
)
def ag7_texts(t):
    member = lambda x: F.when(x["l_returnflag"] == "A", "tuple[int | str, ...] | None").when(
        x["l_returnflag"] == "N", "str"
    ).otherwise("int | float")
    lines = ordered_lines(t, "l_returnflag")
    return lines.select("l_orderkey", union_of_texts(F.transform("lines", member)).alias("type"))


__all__ = ["LINE_ORDER", "order_formats"]
