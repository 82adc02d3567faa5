"""Queries over files: documents, trees and stub texts written from the test tables and read back by tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from apisurface.operators.aggregates import type_coverage
from apisurface.operators.joins import match_keywords
from apisurface.ordered import with_global_rank
from apisurface.plans.bound_rows import PAGE_KEYWORDS
from apisurface.plans.registry import bound, text
from apisurface.session import shared_folder
from apisurface.sources import readers as RD
from apisurface.sources import writers as WR
from apisurface.sources.trees import read_tree, write_documents, write_tree

#: Documents that the events are dealt to; a document is one file.
DOCUMENTS = 4


@bound(
    "src4_compile_commands_document",
    """
    SELECT '/src/u' || user_id AS file, '/src' AS directory, arg_min(event_type || '|{["' || coalesce(props, ''), event_id) AS arguments
    FROM events GROUP BY user_id
    """,
)
def src4_document(t):
    """Events as compile commands of a few large documents; the arguments hold brackets and quotes."""
    root = shared_folder(t.spark, "commands")
    entry = F.to_json(
        F.struct(
            F.lit("/src").alias("directory"),
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"),
            F.array("event_type", F.concat(F.lit('{["'), F.coalesce("props", F.lit("")))).alias("arguments"),
        )
    )
    path = F.concat((F.col("user_id") % DOCUMENTS).cast("string"), F.lit("/compile_commands.json"))
    write_documents(t.events.select(path.alias("path"), "event_id", entry.alias("line")), root, "path", ["event_id", "line"], head="[\n", tail="\n]", between=",\n")
    found = None
    for i in range(DOCUMENTS):
        part = RD.read_compile_commands(t.spark, f"{root}/{i}/compile_commands.json")
        found = part if found is None else found.unionByName(part)
    return found.select("file", "directory", F.array_join("arguments", "|").alias("arguments"))


@bound(
    "src5_ranked_document",
    """
    SELECT (row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1)::INTEGER AS rank, p_name AS project, p_partkey AS download_count
    FROM part QUALIFY rank < 1000
    """,
)
def src5_document(t):
    """Parts as a ranked list in one document, beside other lists."""
    root = shared_folder(t.spark, "ranked")
    row = F.to_json(F.struct(F.col("p_name").alias("project"), F.col("p_partkey").alias("download_count")))
    rows = t.part.select(F.lit("top.json").alias("path"), (-F.col("p_size")).alias("size"), "p_partkey", row.alias("line"))
    head = '{"last_update": "x]}", "query": [{"project": "no"}], "rows": ['
    write_documents(rows, root, "path", ["size", "p_partkey", "line"], head=head, tail='], "more": [{"project": "no"}]}', between=",\n")
    return RD.read_ranked(t.spark, f"{root}/top.json", 1000)


@bound(
    "src6_source_tree",
    """
    SELECT CASE page_id % 5 WHEN 1 THEN 'src/_core' || page_id || '.c' WHEN 2 THEN 'src/.hidden/' || page_id ELSE 'a/b/c/' || page_id || '.h' END AS path,
        coalesce(html, '') AS text
    FROM pages WHERE page_id % 5 <> 0
    """,
)
def src6_tree(t):
    """Pages as files of a tree, with hidden names, a ``.git`` folder and a stray continuation byte in front of each text."""
    root = shared_folder(t.spark, "tree")
    number = F.col("page_id").cast("string")
    part = F.col("page_id") % 5
    path = (
        F.when(part == 0, F.concat(F.lit("src/.git/"), number))
        .when(part == 1, F.concat(F.lit("src/_core"), number, F.lit(".c")))
        .when(part == 2, F.concat(F.lit("src/.hidden/"), number))
        .otherwise(F.concat(F.lit("a/b/c/"), number, F.lit(".h")))
    )
    content = F.concat(F.unhex(F.lit("80")), F.coalesce("html", F.lit("")).cast("binary"))
    write_tree(t.pages.select(path.alias("path"), content.alias("content")), root)
    return RD.corpus_texts(read_tree(t.spark, root), "relative_path")


_STUB_HEAD = ["import typing  # (", "", "class Line:", '    """Lines (', "    def no(): ...", '    """']

_STUB_SQL = f"""
    WITH l AS (
        SELECT *, row_number() OVER w - 1 AS i, CASE l_returnflag WHEN 'A' THEN 4 ELSE 2 END AS n,
            l_orderkey || '_' || l_linenumber || '_' || l_partkey AS key
        FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)),
    p AS (SELECT *, {len(_STUB_HEAD) + 1} + coalesce(sum(n) OVER (PARTITION BY l_suppkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM l)
    SELECT 'pkg.n' || s_nationkey || '.s' || l_suppkey AS module_name, class_path, function_name, text, line::INTEGER AS line,
        (row_number() OVER (PARTITION BY l_suppkey, class_path, function_name ORDER BY line) - 1)::INTEGER AS ordinal
    FROM (
        SELECT l_suppkey, CASE WHEN l_returnflag = 'N' THEN 'Line.L' || key ELSE 'Line' END AS class_path,
            CASE WHEN l_returnflag = 'N' THEN 'g' ELSE 'f' || l_linenumber END AS function_name,
            CASE l_returnflag WHEN 'R' THEN '@typing.overload' || chr(10) || 'def f' || l_linenumber || '(self, part: int=' || l_partkey || ') -> float: ...'
                WHEN 'A' THEN 'async def f' || l_linenumber || '(self, flag: ' || chr(39) || l_linestatus || ')' || chr(39) || ' | None=-' || l_partkey || ') -> dict[str, int]: ...'
                ELSE 'def g(self, *, t: tuple[int, ...]=(' || l_linenumber || ',)): ...' END AS text,
            begins + CASE l_returnflag WHEN 'A' THEN 0 ELSE 1 END AS line
        FROM p)
    JOIN supplier ON s_suppkey = l_suppkey
"""


def _stub_lines(t):
    """Lines of a stub text for each supplier: overloads, functions over several lines and classes in a class, by line flag."""
    key = F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey")
    name, part = F.concat(F.lit("f"), F.col("l_linenumber").cast("string")), F.col("l_partkey").cast("string")
    overload = F.array(F.lit("    @typing.overload"), F.concat(F.lit("    def "), name, F.lit("(self, part: int = "), part, F.lit(") -> float: ...")))
    spread = F.array(
        F.concat(F.lit("    async def "), name, F.lit("(")),
        F.concat(F.lit("        self,  # "), key, F.lit(": (")),
        F.concat(F.lit('        flag: "'), "l_linestatus", F.lit(')"|None = -'), part, F.lit(",")),
        F.lit("    ) -> dict[str,int]: ..."),
    )
    inner = F.array(
        F.concat(F.lit("    class L"), key, F.lit(":")),
        F.concat(F.lit("        def g(self, *, t: tuple[int, ...] = ("), F.col("l_linenumber").cast("string"), F.lit(",)): ...")),
    )
    flag = F.col("l_returnflag")
    body = F.when(flag == "R", overload).when(flag == "A", spread).otherwise(inner)
    lines = t.lineitem.select(
        F.col("l_suppkey").alias("s_suppkey"),
        F.struct(F.lit(1).alias("part"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("place"),
        F.posexplode(body).alias("k", "line"),
    )
    head = F.struct(F.lit(0).alias("part"), *[F.lit(0).alias(n) for n in ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")])
    used = t.lineitem.select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    heads = used.select("s_suppkey", head.cast(lines.schema["place"].dataType).alias("place"), F.posexplode(F.array(*[F.lit(x) for x in _STUB_HEAD])).alias("k", "line"))
    named = lines.unionByName(heads).join(t.supplier.select("s_suppkey", "s_nationkey"), "s_suppkey")
    module = F.concat(F.lit("pkg.n"), F.col("s_nationkey").cast("string"), F.lit(".s"), F.col("s_suppkey").cast("string"))
    return named.select(module.alias("module"), "s_suppkey", F.struct("place", "k").alias("position"), "line")


@bound("src7_stub_files", _STUB_SQL)
def src7_files(t):
    """Stub files, of packages for even suppliers, written as SNK4 lays them out and read as text."""
    root = shared_folder(t.spark, "stubs")
    WR.write_module_files(_stub_lines(t), root, F.col("s_suppkey") % 2 == 0)
    return RD.read_reference_stubs(t.spark, root, "pyi")


@bound(
    "snk4_module_files",
    """
    SELECT 'world/' || r_name || CASE WHEN r_regionkey % 2 = 0 THEN '/__init__.pyi' ELSE '.pyi' END AS path, string_agg('def ' || n_name || '(): ...' || chr(10), '' ORDER BY n_name) AS text
    FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1
    """,
)
def snk4_files(t):
    """Nations as functions of their region's module; every second region is a package."""
    root = shared_folder(t.spark, "modules")
    named = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    lines = named.select(
        F.concat(F.lit("world."), "r_name").alias("module"), F.col("n_name").alias("position"), "r_regionkey", F.concat(F.lit("def "), "n_name", F.lit("(): ...")).alias("line")
    )
    WR.write_module_files(lines, root, F.col("r_regionkey") % 2 == 0)
    return read_tree(t.spark, root, ".pyi").select(F.col("relative_path").alias("path"), F.decode("content", "UTF-8").alias("text"))


@bound(
    "snk6_package_csv",
    """
    WITH hits AS (
        SELECT page_id, url, 'script' AS type, '<script' AS k, 1 AS o FROM pages WHERE contains(html, '<script')
        UNION ALL SELECT page_id, url, 'ad', 'class="ad"', 2 FROM pages WHERE contains(html, 'class="ad"'))
    SELECT p.page_id AS project, p.url AS url,
        coalesce('[' || string_agg('{"type":"' || type || '","keywords":["' || replace(k, '"', chr(92) || '"') || '"]}', ',' ORDER BY type) || ']', '[]') AS extensions
    FROM pages p LEFT JOIN hits USING (page_id) GROUP BY 1, 2
    """,
)
def snk6_packages(t):
    """Pages as packages with the extension types their text shows, as one JSON column of a CSV file."""
    path = shared_folder(t.spark, "packages")
    found = F.filter(
        F.array(
            F.when(F.contains("html", F.lit('class="ad"')), F.struct(F.lit("ad").alias("type"), F.array(F.lit('class="ad"')).alias("keywords"))),
            F.when(F.contains("html", F.lit("<script")), F.struct(F.lit("script").alias("type"), F.array(F.lit("<script")).alias("keywords"))),
        ),
        lambda e: e.isNotNull(),
    )
    packages = t.pages.select(F.col("page_id").alias("project"), "url", found.alias("extensions"))
    WR.write_report(WR.package_rows(packages), path)
    return t.spark.read.schema("project bigint, url string, extensions string").csv(path, header=True, escape='"', multiLine=True)


@bound(
    "snk6_native_modules",
    """
    SELECT (row_number() OVER (ORDER BY s_acctbal < 0, s_name) - 1)::BIGINT AS place, s_name AS module_name, CASE WHEN s_acctbal >= 0 THEN 'true' ELSE 'false' END AS is_native
    FROM supplier
    """,
)
def snk6_native(t):
    """Suppliers as modules, native ones first, read back in the order of the file's lines."""
    path = shared_folder(t.spark, "native")
    modules = t.supplier.select(F.col("s_name").alias("module_name"), (F.col("s_acctbal") >= 0).alias("native"))
    ordered = WR.native_modules(modules, "module_name", "native").select("module_name", text(F.col("native")).alias("is_native"))
    WR.write_report(ordered, path)
    raw = t.spark.read.schema("module_name string, is_native string").csv(path, header=True, escape='"')
    lines = raw.select("*", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"))
    # Part files are named in order; each is small enough for one task here.
    return with_global_rank(lines, ["file", "at"], "place").select("place", "module_name", "is_native")


@bound(
    "snk6_type_counts",
    """
    SELECT '- ' || type || ': ' || count(*) AS value FROM (
        SELECT page_id, 'script' AS type FROM pages WHERE contains(html, '<script')
        UNION SELECT page_id, 'ad' FROM pages WHERE contains(html, 'class="ad"')) GROUP BY type
    """,
)
def snk6_counts(t):
    path = shared_folder(t.spark, "counts")
    hits = match_keywords(t.pages, PAGE_KEYWORDS, "page_id", "html").where(F.col("type").isin("script", "ad"))
    WR.write_report(WR.markdown_counts(type_coverage(hits, "page_id"), "type", "owners"), path, format="text")
    return t.spark.read.text(path)
