"""One large JSON document read by many tasks.

The file is cut into blocks of bytes. Whether a block begins inside of a string and how many brackets are open there follows from
what the blocks before it add: first each task sums its block up for both cases, then these few sums are added along
the file, and in a second pass every task cuts out the objects that begin in its block, reading on past its end for the last one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apisurface.session import shared_folder
from apisurface.sources.trees import _opened

BLOCK = 4 * 1024 * 1024
#: Bytes before a block that are looked at: for backslashes, and for the name of an array that begins the block.
LEAD = 4096
#: Bytes read at a time past the end of a block.
MORE = 1024 * 1024
NAME = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')


_SIGNS = np.zeros(256, bool)
_SIGNS[list(b'"{}[]')] = True
_LEVEL = np.zeros(256, np.int8)
_LEVEL[list(b"{[")], _LEVEL[list(b"}]")] = 1, -1


class _Marks:
    """Brackets and strings of a stretch of bytes, given what comes before it; only the places of signs are held."""

    def __init__(self, lead: bytes, data: bytes, inside: int = 0, depth: int = 0) -> None:
        held = lead[len(lead.rstrip(b"\\")) :]
        both = np.frombuffer(held + data, np.uint8)
        at = np.flatnonzero(_SIGNS[both]).astype(np.int32)
        signs = both[at]
        # A quote is escaped behind an odd run of backslashes.
        quotes = signs == ord('"')
        behind = np.flatnonzero(quotes & (at > 0) & (both[at - 1] == ord("\\")))
        if len(behind):
            slashes = np.flatnonzero(both == ord("\\")).astype(np.int32)
            begins = np.concatenate([[True], np.diff(slashes) > 1])
            firsts = slashes[begins]
            run = at[behind] - firsts[np.searchsorted(firsts, at[behind]) - 1]
            quotes[behind[run % 2 == 1]] = False
        self.data = both[len(held) :]
        # Signs are never among the backslashes that are held from before.
        self.at, self.signs = at - len(held), signs
        self.parity = np.cumsum(quotes, dtype=np.int32)
        self.level = _LEVEL[signs]
        self.start(inside, depth)

    def start(self, inside: int, depth: int) -> None:
        self.level_here = np.where((self.parity + inside) & 1, 0, self.level).astype(np.int8)
        self.after = depth + np.cumsum(self.level_here, dtype=np.int64)

    def ended(self, inside: int, depth: int) -> tuple[int, int]:
        """Whether a string is open behind the stretch, and how many brackets are."""
        return ((inside + int(self.parity[-1])) & 1, int(self.after[-1])) if len(self.at) else (inside, depth)

    def places(self, sign: str, depth: int, after: bool) -> np.ndarray:
        """Where ``sign`` stands outside of strings, with so many brackets open after or before it."""
        level = self.after if after else self.after - self.level_here
        return self.at[(self.signs == ord(sign)) & (self.level_here != 0) & (level == depth)].astype(np.int64)


def _stretch(path: str, offset: int, size: int) -> tuple[bytes, bytes]:
    system, inner = _opened(path)
    with system.open_input_file(inner) as file:
        back = min(offset, LEAD)
        lead = file.read_at(back, offset - back)
        while lead and not lead.strip(b"\\") and len(lead) < offset:
            back = min(offset, 2 * len(lead))
            lead = file.read_at(back, offset - back)
        return lead, file.read_at(size, offset)


def _sums(path: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for number in batch.column(0).to_pylist():
                marks = _Marks(*_stretch(path, number * block, block))
                parity, outside = marks.ended(0, 0)
                marks.start(1, 0)
                out.append((number, parity, outside, marks.ended(1, 0)[1]))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["block", "parity", "outside", "inside"])

    return run


def _cut(path: str, block: int, level: int):
    def whole(marks: _Marks, start: int, offset: int) -> bytes:
        """The object that begins at ``start`` of a block and ends beyond it."""
        parts = [marks.data[start:].tobytes()]
        inside, depth = marks.ended(marks.inside, marks.depth)
        while True:
            lead, data = _stretch(path, offset, MORE)
            if not data:
                raise ValueError(f"{path} ends within an object")
            more = _Marks(lead, data, inside, depth)
            ends = more.places("}", level, True)
            if len(ends):
                return b"".join([*parts, data[: int(ends[0]) + 1]])
            parts.append(data)
            inside, depth = more.ended(inside, depth)
            offset += len(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.string())

        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["kind", "pos", "text"])

        for batch in batches:
            for number, inside, depth in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                base = number * block
                lead, data = _stretch(path, base, block)
                marks = _Marks(lead, data, inside, depth)
                marks.inside, marks.depth = inside, depth
                before = lead + data
                out = []
                for at in marks.places("[", level - 1, False).tolist() if level > 1 else ():
                    name = NAME.search(before[max(0, len(lead) + at - LEAD) : len(lead) + at])
                    out.append(("array", base + at, name[1].decode("utf-8", "replace") if name else None))
                out += [("end", base + at, None) for at in (marks.places("]", level - 1, True).tolist() if level > 1 else ())]
                starts, ends = marks.places("{", level, False), marks.places("}", level, True)
                for start in starts.tolist():
                    k = int(np.searchsorted(ends, start))
                    text = data[start : int(ends[k]) + 1] if k < len(ends) else whole(marks, start, base + len(data))
                    out.append(("object", base + start, text.decode("utf-8")))
                    if len(out) >= 10_000:
                        yield told(out)
                        out = []
                if out:
                    yield told(out)

    return run


def json_objects(spark: SparkSession, path: str, field: str | None = None, block: int = BLOCK) -> DataFrame:
    """``pos`` (in bytes) and ``text`` of each object of the array that the document at ``path`` is, or holds under ``field``.

    Objects come in no order; ``pos`` gives it. A task holds one block and one object. A document without that array is an error.
    """
    system, inner = _opened(path)
    size = system.get_file_info(inner).size
    if size is None:
        raise ValueError(f"there is no file {path}")
    blocks = -(-size // block)
    numbers = spark.range(blocks).repartition(max(1, min(blocks, 2 * spark.sparkContext.defaultParallelism, 10_000)), "id")
    # One row of four numbers for each block.
    sums = sorted(numbers.mapInArrow(_sums(path, block), "block long, parity long, outside long, inside long").collect())
    starts, within, depth = [], 0, 0
    for number, parity, outside, inside in sums:
        starts.append((number, within, depth))
        depth += inside if within else outside
        within ^= parity
    if depth or within:
        raise ValueError(f"{path} is not a whole JSON document")
    level = 1 if field is None else 2
    placed = spark.createDataFrame(starts, "block long, inside long, depth long").repartition(max(1, min(blocks, 2 * spark.sparkContext.defaultParallelism, 10_000)), "block")
    target = shared_folder(spark, "objects")
    placed.mapInArrow(_cut(path, block, level), "kind string, pos long, text string").write.parquet(target)
    found = spark.read.schema("kind string, pos long, text string").parquet(target)
    objects = found.where(F.col("kind") == "object").select("pos", "text")
    if field is None:
        return objects
    begin = found.where((F.col("kind") == "array") & (F.col("text") == field)).agg(F.min("pos")).first()[0]
    if begin is None:
        raise ValueError(f"{path} has no list of {field}")
    end = found.where((F.col("kind") == "end") & (F.col("pos") > begin)).agg(F.min("pos")).first()[0]
    return objects.where((F.col("pos") > begin) & (F.col("pos") < end))
