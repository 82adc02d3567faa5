"""File trees, written and read by tasks.

Spark's own file sources leave out names that begin with ``_`` or ``.``, which a source tree is full of
(``__init__.pyi``, ``_core.c``). Here folders are rows: each round lists the folders that the round before found, so a
tree takes as many rounds as it is deep, whatever its breadth, and no listing passes through the driver.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apisurface.batches import in_arrow, sliced
from apisurface.session import shared_folder

#: Bytes of file contents that one batch of rows holds, if its last file is not larger.
BATCH_BYTES = 4 * 1024 * 1024
#: Bytes of files that one task reads, if they are many.
TASK_BYTES = 64 * 1024 * 1024
LISTED = "path string, relative_path string, size long, is_folder boolean"
CONTENT = "path string, relative_path string, content binary"


def _opened(uri: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (LocalFileSystem(), uri)


def _list_folders(root: str, pruned: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSelector, FileType

        system, base = _opened(root)
        base = base.rstrip("/")
        kinds = (pa.string(), pa.string(), pa.int64(), pa.bool_())
        for batch in sliced(batches):
            found = []
            for inner in batch.column(0).to_pylist():
                for info in system.get_file_info(FileSelector(f"{base}/{inner}".rstrip("/"), allow_not_found=True)):
                    folder = info.type == FileType.Directory
                    if info.type in (FileType.File, FileType.Directory) and not (folder and info.base_name in pruned):
                        found.append((info.path, info.path[len(base) + 1 :], info.size if not folder else 0, folder))
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "relative_path", "size", "is_folder"])

    return run


def list_tree(spark: SparkSession, root: str, prune: Sequence[str] = (".git",)) -> DataFrame:
    """Files below ``root`` as (path, relative_path, size); folders named in ``prune`` are not entered, a missing root has none."""
    frontier, folders = spark.createDataFrame([("",)], "folder string"), 1
    run = _list_folders(root, frozenset(prune))
    found = None
    while True:
        path = shared_folder(spark, "listed")
        dealt = frontier.repartition(min(folders, spark.sparkContext.defaultParallelism), "folder")
        in_arrow(dealt, run, LISTED).write.parquet(path)
        listed = spark.read.schema(LISTED).parquet(path)
        files = listed.where(~F.col("is_folder")).drop("is_folder")
        found = files if found is None else found.unionByName(files)
        frontier = listed.where("is_folder").select(F.col("relative_path").alias("folder"))
        folders = frontier.count()
        if not folders:
            return found


def _read_files(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(root)
        kinds = (pa.string(), pa.string(), pa.binary())

        def told(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "relative_path", "content"])

        held, size = [], 0
        for batch in batches:
            for path, relative in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with system.open_input_stream(path) as stream:
                        content = stream.read()
                except OSError:
                    continue
                held.append((path, relative, content))
                size += len(content)
                if size >= BATCH_BYTES:
                    yield told(held)
                    held, size = [], 0
        if held:
            yield told(held)

    return run


def read_tree(spark: SparkSession, root: str, suffix: str = "", prune: Sequence[str] = (".git",)) -> DataFrame:
    """Files below ``root`` whose name ends in ``suffix`` as (path, relative_path, content); files that cannot be read are skipped."""
    return read_listed(list_tree(spark, root, prune).where(F.endswith("relative_path", F.lit(suffix))), root)


def read_listed(files: DataFrame, root: str) -> DataFrame:
    """Files that ``list_tree`` found below ``root`` as (path, relative_path, content); files that cannot be read are skipped."""
    # Tasks by the bytes that are read; paths alone would go into a few.
    found, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(min(found, files.sparkSession.sparkContext.defaultParallelism), -(-size // TASK_BYTES), 1)
    return in_arrow(files.select("path", "relative_path").repartition(tasks, "path"), _read_files(root), CONTENT)


#: Rows of whole contents that are Python objects at a time.
CONTENT_ROWS = 100


def write_tree(files: DataFrame, root: str, path: str = "path", content: str = "content") -> int:
    """Write each row's content (text or bytes) to its relative path below ``root``; the number of files.

    A file appears under its name when it is whole, so a task that runs again leaves the same tree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(root)
        done = 0
        for batch in sliced(batches, CONTENT_ROWS):
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                target = f"{base.rstrip('/')}/{name}"
                folder, last = os.path.split(target)
                system.create_dir(folder, recursive=True)
                part = f"{folder}/.{last}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as stream:
                    if data.is_valid:
                        stream.write(data.as_buffer())
                system.move(part, target)
            done += batch.num_rows
        yield pa.record_batch([pa.array([done], pa.int64())], ["n"])

    rows = files.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content"))
    return in_arrow(rows, run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_line_files(lines: DataFrame, root: str, suffix: str, package: str = "package", module: str = "module", line: str = "line") -> int:
    """One file for each ``module``, whose rows follow each other in one task, below ``root``: its lines as they come; the number of files.

    A line that is null is left out. A file is that of a package if any of its rows says so. The lines of a batch are written at once as they lie in it, none is a
    Python object, and a file may be larger than a task. It appears under its name when it is whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(root)
        base, done, made = base.rstrip("/"), 0, set()
        held, stream, part, packaged, empty = None, None, "", False, True

        def folder_of(target: str) -> tuple[str, str]:
            folder, last = os.path.split(target)
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            return folder, last

        def end() -> None:
            if empty:
                stream.write(b"\n")
            stream.close()
            target = f"{base}/{module_path(held, packaged, suffix)}"
            folder_of(target)
            system.move(part, target)

        try:
            for batch in batches:
                names, flags, texts = batch.columns
                runs = pc.run_end_encode(names)
                wide = pa.types.is_large_binary(texts.type)
                places = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
                bytes_ = texts.buffers()[2]
                begins = 0
                for name, ends in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                    if stream is None or name != held:
                        if stream is not None:
                            end()
                            stream = None
                        folder, last = folder_of(f"{base}/{module_path(name, False, suffix)}")
                        held, packaged, empty, part = name, False, True, f"{folder}/.{last}.{uuid.uuid4().hex}"
                        stream = system.open_output_stream(part)
                        done += 1
                    if size := int(places[ends] - places[begins]):
                        stream.write(bytes_.slice(int(places[begins]), size))
                        empty = False
                    packaged = packaged or bool(pc.any(flags.slice(begins, ends - begins)).as_py())
                    begins = ends
            if stream is not None:
                end()
                stream = None
        finally:
            if stream is not None:
                stream.close()
        yield pa.record_batch([pa.array([done], pa.int64())], ["n"])

    ended = F.coalesce(F.concat(F.col(line), F.lit("\n")), F.lit("")).cast("binary").alias("line")
    rows = lines.select(F.col(module).alias("module"), F.col(package).alias("package"), ended)
    return in_arrow(rows, run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def module_path(module: str | None, package: bool, suffix: str) -> str:
    """Relative path of a module text: ``a/b/__init__`` for a package, ``a/b`` for a leaf."""
    folder = module.replace(".", "/") if module is not None else None
    return f"{folder}{'/__init__' if package else ''}{suffix}" if folder is not None else "None"


#: Bytes that are copied at a time where parts are put together.
COPY_BYTES = 8 * 1024 * 1024
#: Lines of a part that are Python objects at a time.
PART_LINES = 1000


def write_documents(
    lines: DataFrame, root: str, path: str, order: Sequence[Column | str], line: str = "line", head: str = "", tail: str = "", between: str = ""
) -> int:
    """One file for each value of ``path`` below ``root``: ``head``, its lines in ``order`` with ``between`` them, ``tail``; the number of files.

    Lines are dealt to ranges of (path, order) and written as parts by many tasks; a task then copies the parts of a file one
    after the other, a stretch at a time, so a file may be larger than any task.
    """
    spark, folder = lines.sparkSession, shared_folder(lines.sparkSession, "parts")
    content = F.col(line).cast("binary").alias("line")
    ranked = lines.select(F.col(path).alias("path"), content, *[F.col(c).alias(f"_o{i}") if isinstance(c, str) else c.alias(f"_o{i}") for i, c in enumerate(order)])
    keys = ["path", *[f"_o{i}" for i in range(len(order))]]
    dealt = ranked.repartitionByRange(*keys).sortWithinPartitions(*keys).select("path", "line", F.spark_partition_id().alias("range"))
    glue = between.encode()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(folder)
        base = base.rstrip("/")
        system.create_dir(base, recursive=True)
        told, stream = [], None
        try:
            for batch in sliced(batches, PART_LINES):
                rows = zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True)
                for name, group in groupby(rows, key=itemgetter(0)):
                    found = list(group)
                    if not told or told[-1][0] != name:
                        if stream is not None:
                            stream.close()
                        target = f"{base}/{uuid.uuid4().hex}"
                        stream = system.open_output_stream(target)
                        told.append((name, found[0][2], target))
                    else:
                        stream.write(glue)
                    stream.write(glue.join(data or b"" for _, data, _ in found))
        finally:
            if stream is not None:
                stream.close()
        columns = zip(*told, strict=True) if told else [[]] * 3
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string()), strict=True)], ["path", "range", "part"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(root)
        done = 0
        for batch in batches:
            for name, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = f"{base.rstrip('/')}/{name}"
                inner, last = os.path.split(target)
                system.create_dir(inner, recursive=True)
                made = f"{inner}/.{last}.{uuid.uuid4().hex}"
                with system.open_output_stream(made) as out:
                    out.write(head.encode())
                    for i, part in enumerate(listed):
                        if i:
                            out.write(glue)
                        with system.open_input_stream(part["part"]) as source:
                            while data := source.read(COPY_BYTES):
                                out.write(data)
                    out.write(tail.encode())
                system.move(made, target)
                done += 1
        yield pa.record_batch([pa.array([done], pa.int64())], ["n"])

    # Written once, so that a task that runs again names the same parts.
    names = shared_folder(spark, "part-names")
    in_arrow(dealt, parts, "path string, range int, part string").write.parquet(names)
    listed = spark.read.schema("path string, range int, part string").parquet(names).groupBy("path")
    listed = listed.agg(F.transform(F.sort_array(F.collect_list(F.struct("range", "part"))), lambda p: F.struct(p["part"].alias("part"))).alias("parts"))
    files, cores = listed.count(), spark.sparkContext.defaultParallelism
    return in_arrow(listed.repartition(max(1, min(files, cores)), "path"), whole, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
