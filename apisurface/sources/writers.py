"""Writers for records, measurements, summaries, module texts and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from apisurface import schemas as S
from apisurface.sources.trees import write_line_files


def require_signatures(df: DataFrame, signatures: str = "signatures", name: str = "function_id") -> DataFrame:
    """The rows unchanged; a function without signatures makes the query fail."""
    present = F.coalesce(F.size(signatures) > 0, F.lit(False))
    message = F.concat(F.lit("no signatures: "), F.coalesce(F.col(name).cast("string"), F.lit("")))
    return df.where(F.when(present, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def write_function_records(df: DataFrame, path: str, format: str = "json", mode: str = "errorifexists") -> None:
    """Function records, one object per line; null optional fields are left out of JSON."""
    known = [c for c in S.column_names(S.FUNCTIONS) if c in df.columns]
    checked = require_signatures(df.select(*known))
    writer = checked.write.mode(mode)
    if format == "json":
        writer = writer.option("ignoreNullFields", True)
    writer.format(format).save(path)


def write_measurements(df: DataFrame, path: str, col: str = "elapsed_ns", mode: str = "errorifexists") -> None:
    """Measurements as CSV, slowest first across the part files in their order."""
    df.orderBy(F.col(col).desc()).write.mode(mode).csv(path, header=True, escape='"')


def write_summary(df: DataFrame, path: str, rows: DataFrame | None = None, file: str | None = None, mode: str = "errorifexists") -> None:
    """Summary rows as JSON lines below ``path``; the files that ``rows`` came from, one row each, in ``path``-files."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
    if rows is not None:
        rows.select(F.col(file).alias("input_file")).distinct().write.mode(mode).json(f"{path.rstrip('/')}-files")


def write_module_texts(
    lines: DataFrame, path: str, module: str = "module", order: str = "position", line: str = "line", mode: str = "errorifexists"
) -> None:
    """Text lines in one folder per module.

    Lines are range partitioned by (module, order), so a big module is spread over several part files
    whose names follow the line order.
    """
    ranged = lines.repartitionByRange(module, order).sortWithinPartitions(module, order)
    ranged.select(module, F.col(line).alias("value")).write.mode(mode).partitionBy(module).text(path)


def write_module_files(
    lines: DataFrame, root: str, is_package: Column, module: str = "module", order: str = "position", line: str = "line", suffix: str = ".pyi"
) -> int:
    """One file per module below ``root``, where ``module_path`` puts it; the number of files.

    The lines of a module make one text, as the text of a module is one file. They are sorted as rows and go to the file from there,
    so the text of a module is never one value.
    """
    rows = lines.select(F.col(module).alias("module"), is_package.alias("package"), F.col(order).alias("at"), F.col(line).alias("line"))
    return write_line_files(rows.repartition("module").sortWithinPartitions("module", "at", "line"), root, suffix)


def append_evaluations(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    columns: list[str] | None = None,
    format: str = "csv",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append evaluation rows to files as they finish.

    ``trigger`` is that of the stream, such as ``{"processingTime": "1 minute"}``; without one, what is there is appended
    and the query ends.
    """
    chosen = columns or [c for c in S.column_names(S.EVALUATIONS) if c in stream.columns]
    return (
        stream.select(*chosen)
        .writeStream.format(format)
        .option("header", True)
        .option("escape", '"')
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def package_rows(df: DataFrame, extensions: str = "extensions") -> DataFrame:
    """Package table with its extensions as one JSON column."""
    return df.withColumn(extensions, F.coalesce(F.to_json(extensions), F.lit("[]")))


def markdown_counts(df: DataFrame, kind: str, count: str, out: str = "line") -> DataFrame:
    """``- type: count`` lines sorted by type."""
    return df.orderBy(kind).select(F.concat(F.lit("- "), F.col(kind), F.lit(": "), F.col(count).cast("string")).alias(out))


def native_modules(df: DataFrame, name: str, flag: str) -> DataFrame:
    """Module table with native modules first, then by name."""
    return df.orderBy(F.col(flag).desc(), name)


def write_report(df: DataFrame, path: str, format: str = "csv", mode: str = "errorifexists") -> None:
    """Report rows as CSV with a header, or as text lines."""
    if format == "text":
        df.write.mode(mode).text(path)
    else:
        df.write.mode(mode).option("header", True).option("escape", '"').format(format).save(path)
