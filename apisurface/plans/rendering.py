"""Module texts from a catalog tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apisurface.functions.render import class_header, function_lines, indent
from apisurface.functions.text import doc_lines
from apisurface.operators.aggregates import module_imports
from apisurface.operators.projections import flatten_tree

# Order of the parts of a module text.
_HEADER, _IMPORT, _SUBMODULE, _BODY = 0, 1, 2, 3


def _class_path(modules: Column) -> Column:
    """Names below the module in a sort path."""
    return F.filter(modules, lambda step: step["rank"] != 3)


def catalog_paths(nodes: DataFrame) -> DataFrame:
    """Nodes with module name, class path and text order; classes come before functions."""
    flat = flatten_tree(nodes, kind="kind", kind_order=("class", "function", "module"))
    modules = F.filter("sort_path", lambda step: step["rank"] == 3)
    inner = _class_path(F.col("sort_path"))
    return nodes.join(flat.select("node_id", "sort_path", "depth"), "node_id").select(
        *nodes.columns,
        F.array_join(F.transform(modules, lambda m: m["name"]), ".").alias("module"),
        inner.alias("inner_path"),
        F.size(inner).alias("level"),
    )


def module_lines(nodes: DataFrame, signatures: DataFrame, include_docs: bool = False) -> DataFrame:
    """Lines (module, position, line) of every module text.

    ``nodes`` holds node_id, parent_id, kind, name, doc and bases; ``signatures`` holds node_id, signature_index,
    args, return_type, imports and decorator. Lines stay rows: a module is never gathered in one place. A function
    without signatures makes the query fail and is named.
    """
    paths = catalog_paths(nodes)
    placed = paths.where(F.col("kind") == "function").drop("kind", "bases").join(signatures, "node_id", "left")
    counts = signatures.groupBy("node_id").agg(F.count(F.lit(1)).alias("_signatures"))
    placed = placed.join(counts, "node_id", "left")
    missing = F.raise_error(F.concat(F.lit("no signatures: "), F.col("node_id").cast("string"))).cast("boolean")
    placed = placed.where(F.when(F.col("_signatures").isNull(), missing).otherwise(F.lit(True)))

    def block(df: DataFrame, part: Column, index: Column, lines: Column) -> DataFrame:
        return df.select(
            "module", part.alias("_part"), F.col("inner_path").alias("_path"), index.alias("_index"),
            F.posexplode(lines).alias("_line", "line"),
        )

    nested = F.col("level") - 1
    decorator = F.when(F.col("level") > 1, F.col("decorator"))
    doc = F.col("doc") if include_docs else None
    functions = block(
        placed, F.lit(_BODY), F.col("signature_index"),
        indent(function_lines("name", "args", "return_type", F.col("_signatures") > 1, decorator, doc), nested),
    )
    classes = paths.where(F.col("kind") == "class")
    children = nodes.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("node_id")).distinct()
    filled = classes.join(children.withColumn("_filled", F.lit(True)), "node_id", "left")
    empty = F.col("_filled").isNull()
    body = F.array().cast("array<string>")
    if include_docs:
        body = F.when(F.col("doc").isNotNull(), doc_lines("doc")).otherwise(body)
    body = F.when(empty & (F.size(body) == 0), F.array(F.lit("pass"))).otherwise(body)
    heads = block(
        filled, F.lit(_BODY), F.lit(-1), indent(F.concat(F.array(class_header("name", "bases")), indent(body)), nested)
    )
    modules = paths.where(F.col("kind") == "module")
    parent = F.regexp_replace("module", "\\.[^.]*$", "")
    submodules = modules.where(F.contains("module", F.lit("."))).select(
        parent.alias("module"), F.lit(_SUBMODULE).alias("_part"),
        F.array(F.struct(F.lit(0).alias("rank"), F.col("name"))).alias("_path"), F.lit(0).alias("_index"),
        F.lit(0).alias("_line"), F.concat(F.lit("from . import "), F.col("name")).alias("line"),
    )
    imports = module_imports(placed, ["module"], "imports", F.col("_signatures")).select(
        "module", F.explode("imports").alias("_import")
    )
    import_lines = imports.select(
        "module", F.lit(_IMPORT).alias("_part"),
        F.array(F.struct(F.lit(0).alias("rank"), F.col("_import").alias("name"))).alias("_path"),
        F.lit(0).alias("_index"), F.lit(0).alias("_line"), F.concat(F.lit("import "), F.col("_import")).alias("line"),
    )
    parts = [functions, heads, submodules, import_lines]
    if include_docs:
        parts.append(block(modules.where(F.col("doc").isNotNull()), F.lit(_HEADER), F.lit(0), doc_lines("doc")))
    lines = parts[0]
    for other in parts[1:]:
        lines = lines.unionByName(other)
    return lines.select("module", F.struct("_part", "_path", "_index", "_line").alias("position"), "line")
