"""Readers with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apisurface import schemas as S
from apisurface.functions.text import blank_to_null, decode_ignoring, join_path, strip
from apisurface.operators.sets import missing_columns
from apisurface.operators.windows import with_ordinal
from apisurface.ordered import with_global_rank
from apisurface.sources.json_blocks import json_objects
from apisurface.sources.stubs import module_of, stub_functions
from apisurface.sources.trees import list_tree, read_listed, read_tree

REQUIRED_TEXT = [
    "function_id", "module_name", "function_name", "provider",
    "parameter_inference_status", "return_inference_status",
]
OPTIONAL_TEXT = ["failure_reason"]


def validated_functions(df: DataFrame) -> DataFrame:
    """Function records with required text present, optional blank text nulled and signatures listed."""
    problem = F.coalesce(
        *[
            F.when(strip(F.coalesce(F.col(c), F.lit(""))) == "", F.lit(f"{c} is missing or blank"))
            for c in REQUIRED_TEXT
        ],
        F.when(F.col("signatures").isNull(), F.lit("signatures are missing")),
        F.when(
            F.exists("signatures", lambda s: strip(F.coalesce(s["signature"], F.lit(""))) == ""),
            F.lit("a signature is missing or blank"),
        ),
    )
    message = F.concat(problem, F.lit(" in "), F.coalesce(F.col("function_id"), F.lit("a record")))
    checked = df.where(F.when(problem.isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
    signatures = F.transform(
        "signatures",
        lambda s, i: F.struct(
            i.cast("int").alias("signature_index"),
            s["signature"].alias("signature"),
            strip(blank_to_null(s["raw_signature"])).alias("raw_signature"),
        ),
    )
    cleaned = {c: strip(blank_to_null(c)) for c in OPTIONAL_TEXT}
    return checked.withColumns({**cleaned, "signatures": signatures})


def read_function_records(spark: SparkSession, path: str | Sequence[str], format: str = "json") -> DataFrame:
    """Function records from JSON lines or Parquet.

    A JSON document ``{"functions": [...]}`` is read with ``format="json_document"``.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if format == "json":
        raw = spark.read.schema(S.FUNCTIONS).option("mode", "FAILFAST").json(paths)
    elif format == "json_document":
        schema = f"functions array<struct<{', '.join(f.replace(' ', ':', 1) for f in _fields(S.FUNCTIONS))}>>"
        documents = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(paths)
        listed = F.when(F.col("functions").isNull(), F.raise_error(F.lit("document has no list of functions"))).otherwise(
            F.col("functions")
        )
        raw = documents.select(F.explode(listed).alias("f")).select("f.*")
    else:
        raw = spark.read.schema(S.FUNCTIONS).format(format).load(paths)
    return validated_functions(raw)


def _fields(ddl: str) -> list[str]:
    return [f"{f.name} {f.dataType.simpleString()}" for f in T.StructType.fromDDL(ddl).fields]


def read_measurements(spark: SparkSession, paths: str | Sequence[str], source: str = "source_csv") -> DataFrame:
    """Measurement CSV files with a header; empty provider and failure reason become null.

    A file whose header lacks a required column is an error that lists the columns.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    names = S.column_names(S.MEASUREMENTS)
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        header = spark.read.csv(path, header=True, escape='"')
        absent = missing_columns(header, names)
        if absent:
            raise ValueError(f"{path} lacks columns: {', '.join(absent)}")
        by_header.setdefault(tuple(header.columns), []).append(path)
    # Files of one header are one scan; a deviating file below a folder fails the header check.
    raw = None
    for header, same in by_header.items():
        schema = ", ".join(f"`{c}` string" for c in header)
        scan = spark.read.schema(schema).csv(same, header=True, multiLine=True, escape='"', enforceSchema=False)
        part = scan.select(*names, F.col("_metadata.file_path").alias(source))
        raw = part if raw is None else raw.unionByName(part)
    if raw is None:
        raise ValueError("no measurement files given")
    return raw.select(
        "function_id",
        F.col("elapsed_ns").cast("bigint").alias("elapsed_ns"),
        F.col("elapsed_ms").cast("double").alias("elapsed_ms"),
        F.nullif("provider", F.lit("")).alias("provider"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in names[4:7]],
        F.col("signature_count").cast("int").alias("signature_count"),
        F.nullif("failure_reason", F.lit("")).alias("failure_reason"),
        source,
    )


def read_evaluations(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Evaluation CSV; no path gives an empty table.

    Columns are found by the header, in any order; a missing one is an error, further ones are left out. All files
    of a folder must have the header of the first.
    """
    if path is None:
        return spark.createDataFrame([], S.EVALUATIONS)
    header = spark.read.csv(path, header=True, escape='"').columns
    absent = sorted(set(S.column_names(S.EVALUATIONS)) - set(header))
    if absent:
        raise ValueError(f"{path} lacks columns: {', '.join(absent)}")
    schema = ", ".join(f"`{c}` string" for c in header)
    scan = spark.read.schema(schema).csv(
        path, header=True, multiLine=True, escape='"', mode="FAILFAST", enforceSchema=False
    )
    wanted = T.StructType.fromDDL(S.EVALUATIONS).fields
    return scan.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted])


def first_commands(commands: DataFrame, file: str = "file", position: str = "pos") -> DataFrame:
    """First command of each file."""
    rest = [c for c in commands.columns if c not in (file, position)]
    first = F.min_by(F.struct(*rest), F.col(position)).alias("_first")
    return commands.groupBy(file).agg(first).select(file, "_first.*")


def read_compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """First compile command per source file of a ``compile_commands.json``."""
    if path.rstrip("/").rsplit("/", 1)[-1] != "compile_commands.json":
        raise ValueError(f"file must be named compile_commands.json: {path}")
    entry = "directory string, file string, command string, arguments array<string>, output string"
    parsed = F.from_json("text", entry, {"mode": "FAILFAST"}).alias("entry")
    numbered = json_objects(spark, path).select("pos", parsed).select("pos", "entry.*").select(
        "pos",
        join_path("directory", "file").alias("file"),
        "directory",
        F.coalesce("arguments", F.split("command", " +")).alias("arguments"),
    )
    return first_commands(numbered)


def read_ranked(spark: SparkSession, path: str, n: int, row_schema: str = "project string, download_count bigint") -> DataFrame:
    """First n entries of the ``rows`` array of a ranked package list, with their rank; the document may be larger than a task."""
    ranked = with_global_rank(json_objects(spark, path, "rows"), ["pos"]).where(F.col("rank") < n)
    parsed = F.from_json("text", row_schema, {"mode": "FAILFAST"}).alias("row")
    return ranked.select(F.col("rank").cast("int").alias("rank"), parsed).select("rank", "row.*")


def corpus_texts(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, text) of binary files outside ``.git``; invalid UTF-8 bytes are left out."""
    kept = files.where(~F.contains(path, F.lit("/.git/")))
    return kept.select(F.col(path).alias("path"), decode_ignoring(F.col(content)).alias("text"))


def read_source_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root`` outside ``.git`` as (path, text); unreadable files are skipped."""
    return corpus_texts(read_tree(spark, root))


def ambiguous_modules(files: DataFrame, module: str = "module_name") -> DataFrame:
    """Modules described by more than one file."""
    return files.groupBy(module).agg(F.count(F.lit(1)).alias("files")).where(F.col("files") > 1)


#: A reference table: the file that describes a module, the function, its text and line.
REFERENCES = "file string, module_name string, class_path string, function_name string, text string, line int"


def read_reference_stubs(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Reference signatures with the ordinal of each among the overloads of its function.

    They come from JSON lines or Parquet, or with ``format="pyi"`` from the stub files below a folder. A module that two files
    describe is an error that names it.
    """
    if format == "pyi":
        listed = list_tree(spark, path).where(F.endswith("relative_path", F.lit(".pyi")))
        texts = read_listed(listed, path).select(F.col("relative_path").alias("file"), F.decode("content", "UTF-8").alias("text"))
        rows = stub_functions(texts).withColumn("module_name", module_of("file"))
        described = listed.select(F.col("relative_path").alias("file"), module_of("relative_path").alias("module_name"))
    else:
        rows = spark.read.schema(REFERENCES).format(format).load(path)
        described = rows.select("module_name", "file").distinct()
    message = F.concat(F.lit("two stub files describe module "), F.col("module_name"))
    twice = ambiguous_modules(described).select("module_name", F.raise_error(message).cast("boolean").alias("_bad"))
    checked = rows.join(twice, "module_name", "left").where(F.coalesce("_bad", F.lit(True))).drop("_bad")
    return stub_signatures(checked)


def stub_signatures(rows: DataFrame) -> DataFrame:
    """Reference rows numbered by line within their function, whose overloads are few."""
    numbered = with_ordinal(rows, ["module_name", "class_path", "function_name"], ["line", "text"], bucketed=False)
    return numbered.select(
        "module_name", "class_path", "function_name", F.col("ordinal").cast("int").alias("ordinal"), "text", "line"
    )
