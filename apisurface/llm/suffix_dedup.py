"""Suffix-array dedup: bytes covered by a string of given width that starts earlier somewhere else.

Suffixes are dealt to tasks by anchors: in every window of ``width`` bytes the 32-byte stretch of smallest hash, which
is the same wherever the window occurs. Occurrences whose whole surroundings are equal count as one class, and the first of a
class stands for it; members of a class are told by 128 hash bits (64 of the anchor, 64 of the surroundings with the place
of the anchor), and their bytes are not compared. Where an anchor has several classes, the suffixes around it are sorted: a mergesort compares
two suffixes by the hashes of their prefixes, finding their common extension by binary search, and neighbours that
come out equal are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apisurface.llm.frames import fresh, in_arrow, pick, sliced, stored
from apisurface.llm.hashing import U64, mix, prefix_hashes, stretch, windows

ANCHOR = 32
#: Window starts that are searched for anchors at a time; their places fit the low bits of a sort key.
CHUNK = 1 << 19
PLACE_BITS = U64(20)
#: Anchors of one task that are compared with each other before they leave it.
COMBINE = 200_000
#: Contexts that are sorted at a time, if their anchors end there.
SORT_CONTEXTS = 4096
#: Windows that are sorted at a time.
SORT_WINDOWS = 400_000
NO_ID = -(1 << 63)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from the running minima of blocks in both directions."""
    n = len(values)
    filled = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, U64)
    filled[:n] = values
    blocks = filled.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor: its hash, a hash of all the bytes they cover, first and last start, its place."""
    reach = width - ANCHOR + 1
    mask = (U64(1) << PLACE_BITS) - U64(1)
    found = []
    at, n_windows = 0, len(data) - width + 1
    while at < n_windows:
        # Only the bytes of one chunk are taken apart at a time; the run that its end may cut begins the next chunk.
        prefix = prefix_hashes(data[at : at + CHUNK + width - 1])
        stretches = mix(windows(prefix, ANCHOR))
        place = (sliding_min((stretches & ~mask) | np.arange(len(stretches), dtype=U64), reach) & mask).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        last = np.concatenate([first[1:], [len(place)]]) - 1
        if at + len(place) < n_windows and len(first) > 1:
            first, last = first[:-1], last[:-1]
        place = place[first]
        around = stretch(prefix, first, last + width)
        whole = mix(around ^ mix(((place - first) * 128 + (last - first)).astype(U64)))
        found.append((stretches[place], whole, first + at, last + at, place + at))
        at += int(last[-1]) + 1
    return tuple(np.concatenate(columns) for columns in zip(*found, strict=True))


def packed(start: np.ndarray, length: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Start, further starts and anchor offset in one number that sorts by start."""
    return (start << 14) | (length << 7) | offset


def unpacked(pos: np.ndarray) -> tuple[np.ndarray, ...]:
    return pos >> 14, (pos >> 7) & 127, pos & 127


def find_anchors(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Anchors of the documents of a task, each class once; spans of its later members are certain and go out as such."""
    docs: list[tuple] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal docs, size
        if not docs:
            return
        a, c, first, last, place = (np.concatenate([d[2][i] for d in docs]) for i in range(5))
        counts = [len(d[2][0]) for d in docs]
        doc = np.repeat(np.array([d[0] for d in docs], np.int64), counts)
        tie = np.repeat(np.array([d[1] for d in docs], np.int64), counts)
        docs, size = [], 0
        pos = packed(first, last - first, place - first)
        order = np.lexsort((pos, tie, doc, c, a))
        yield from class_rows(a[order], c[order], doc[order], tie[order], pos[order], width)

    for batch in sliced(batches):
        rows = zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True)
        for doc, tie, text in rows:
            data = np.frombuffer(text, np.uint8)
            if len(data) >= width:
                docs.append((doc, tie, anchors(data, width)))
                size += len(docs[-1][2][0])
                if size >= COMBINE:
                    yield from flush()
    yield from flush()


def class_rows(a: np.ndarray, c: np.ndarray, doc: np.ndarray, tie: np.ndarray, pos: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """Of sorted anchors: the first of each class with ``until`` -1, and spans (until >= 0) of the others, dealt by document."""
    head, of_class = class_heads(a, c)
    later = later_rows(of_class, doc, tie, pos)
    yield anchor_batch(a[head], c[head], doc[head], tie[head], pos[head], np.full(int(head.sum()), -1, np.int64))
    start, more, _ = unpacked(pos[later])
    d, tie, start, end = merged_spans(doc[later], tie[later], start, start + more + width)
    zero = np.zeros(len(d), np.int64)
    yield anchor_batch(mix(d.astype(U64) ^ mix(tie.astype(U64))), zero.astype(U64), d, tie, packed(start, zero, zero), end)


def later_rows(of_class: np.ndarray, *places: np.ndarray) -> np.ndarray:
    """Which rows lie elsewhere than the first of their class; rows of equal documents lie in one place."""
    return np.logical_or.reduce([p != p[of_class] for p in places])


def class_heads(a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows begin a class, and for each row the place where its class begins."""
    head = np.ones(len(a), bool)
    head[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    return head, np.flatnonzero(head)[np.cumsum(head) - 1] if len(a) else np.zeros(0, np.int64)


def merged_spans(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal spans of each document."""
    order = np.lexsort((start, tie, doc))
    doc, tie, start, end = doc[order], tie[order], start[order], end[order]
    if not len(doc):
        return doc, tie, start, end
    other = np.ones(len(doc), bool)
    other[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])
    group = np.cumsum(other)
    # Ends grow along the order within a document once shifted by its number.
    reach = np.maximum.accumulate(end + group * (1 << 36)) - group * (1 << 36)
    fresh = other.copy()
    fresh[1:] |= start[1:] > reach[:-1]
    heads = np.flatnonzero(fresh)
    tails = np.concatenate([heads[1:], [len(doc)]]) - 1
    return doc[heads], tie[heads], start[heads], reach[tails]


def anchor_batch(a, c, doc, tie, pos, until) -> pa.RecordBatch:
    columns = [pa.array(x) for x in (a.view(np.int64), c.view(np.int64), doc, tie, pos, until)]
    return pa.record_batch(columns, ["a", "c", "doc", "tie", "pos", "until"])


def groups_of(batches: Iterator[pa.RecordBatch], columns: int, at_least: int) -> Iterator[list]:
    """Columns of sorted rows in pieces that never cut a value of the first column."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < at_least:
            continue
        keys = held[-1].column(0).to_numpy()
        cut = int(np.searchsorted(np.cumsum(np.concatenate([[False], keys[1:] != keys[:-1]])), np.sum(keys[1:] != keys[:-1])))
        if cut:
            whole = pa.Table.from_batches([*held[:-1], held[-1].slice(0, cut)])
            yield [whole.column(i).combine_chunks() for i in range(columns)]
            held = [held[-1].slice(cut)]
            rows = held[0].num_rows
    if held:
        whole = pa.Table.from_batches(held)
        yield [whole.column(i).combine_chunks() for i in range(columns)]


def judge_anchors(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Of anchors sorted by hash, class, document and place: spans of later class members, and first members to be sorted."""
    for columns in groups_of(batches, 6, 100_000):
        a, c, doc, tie, pos, until = (x.to_numpy(zero_copy_only=False) for x in columns)
        told = until >= 0
        yield span_batch(doc[told], tie[told], unpacked(pos[told])[0], until[told])
        a, c, doc, tie, pos = a[~told], c[~told], doc[~told], tie[~told], pos[~told]
        head, of_class = class_heads(a, c)
        later = later_rows(of_class, doc, tie, pos)
        start, more, _ = unpacked(pos[later])
        yield span_batch(*merged_spans(doc[later], tie[later], start, start + more + width))
        a, doc, tie, pos = a[head], doc[head], tie[head], pos[head]
        several = np.zeros(len(a), bool)
        several[1:] = a[1:] == a[:-1]
        several[:-1] |= several[1:].copy()
        start, more, offset = unpacked(pos[several])
        yield span_batch(doc[several], tie[several], start, start + more + width, a[several], offset)


def span_batch(doc, tie, start, end, a=None, offset=None) -> pa.RecordBatch:
    empty = pa.nulls(len(doc), pa.int64())
    columns = [*[pa.array(x, pa.int64()) for x in (doc, tie, start, end)], *[empty if x is None else pa.array(x, pa.int64()) for x in (a, offset)]]
    return pa.record_batch(columns, ["doc", "tie", "start", "end", "a", "offset"])


def cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around the anchors to be sorted, from the texts they lie in."""
    for batch in sliced(batches):
        out: list[tuple] = []
        for doc, tie, text, reps in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            out.extend((r["a"], doc, tie, r["start"], r["offset"], text[r["start"] : r["end"]]) for r in reps)
        for at in range(0, len(out), 5000):
            kinds = (*[pa.int64()] * 5, pa.binary())
            columns = [pa.array(x, k) for x, k in zip(zip(*out[at : at + 5000], strict=True), kinds, strict=True)]
            yield pa.record_batch(columns, ["a", "doc", "tie", "start", "offset", "bytes"])


def common_extension(prefix: np.ndarray, x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common start of each two suffixes, ``limit`` at most, by binary search over prefix hashes."""
    low, high = np.zeros(len(x), np.int64), np.full(len(x), limit, np.int64)
    while (open_ := low < high).any():
        middle = (low + high + 1) >> 1
        same = stretch(prefix, x, x + middle) == stretch(prefix, y, y + middle)
        low = np.where(open_ & same, middle, low)
        high = np.where(open_ & ~same, middle - 1, high)
    return low


def sort_suffixes(data: np.ndarray, prefix: np.ndarray, at: np.ndarray, bucket: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes by bucket, then by their first ``limit`` bytes, and whether each equals the one before it.

    Bottom-up mergesort, all merges of a round at once: each suffix finds by binary search how many of the sibling run
    come before it. Equal suffixes keep their order. Neighbours that are equal by hash are compared byte by byte.
    """
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    begin = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([begin, [len(b)]]))
    first, size = np.repeat(begin, sizes), np.repeat(sizes, sizes)
    inside = np.arange(len(b)) - first
    run = 1
    while len(sizes) and run < sizes.max():
        own_run = inside // run
        sibling = (own_run ^ 1) * run
        n_sibling = np.clip(size - sibling, 0, run)
        moved = np.flatnonzero((n_sibling > 0))
        low, high = np.zeros(len(moved), np.int64), n_sibling[moved].copy()
        base = first[moved] + sibling[moved]
        left = (own_run[moved] & 1) == 0
        me = at[order[moved]]
        while (live := np.flatnonzero(low < high)).size:
            middle = (low[live] + high[live]) >> 1
            other = at[order[base[live] + middle]]
            same = common_extension(prefix, other, me[live], limit)
            ended = same == limit
            step = np.minimum(same, limit - 1)
            # A left element goes before equal ones of the right run, a right element behind those of the left.
            before = np.where(ended, ~left[live], data[other + step] < data[me[live] + step])
            low[live] = np.where(before, middle + 1, low[live])
            high[live] = np.where(before, high[live], middle)
        target = np.arange(len(b))
        target[moved] = first[moved] + np.minimum(own_run[moved] * run, sibling[moved]) + inside[moved] % run + low
        merged = np.empty_like(order)
        merged[target] = order
        order = merged
        run *= 2
    equal = np.zeros(len(order), bool)
    near = np.flatnonzero(b[1:] == b[:-1]) + 1
    x, y = at[order[near - 1]], at[order[near]]
    hashed = stretch(prefix, x, x + limit) == stretch(prefix, y, y + limit)
    near, x, y = near[hashed], x[hashed], y[hashed]
    steps = np.arange(limit)
    for part in range(0, len(near), 20_000):
        cut = slice(part, part + 20_000)
        equal[near[cut]] = (data[x[cut, None] + steps] == data[y[cut, None] + steps]).all(axis=1)
    return order, equal


def ends_of(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last eight bytes of the window that begins at each place."""
    eight = np.arange(8)
    return tuple(np.ascontiguousarray(data[at[:, None] + eight + skip]).view(U64).ravel() for skip in (0, width - 8))


def repeated_windows(data, prefix, at: np.ndarray, bucket: np.ndarray, width: int) -> np.ndarray:
    """Which windows equal an earlier one of their bucket. Suffixes are dealt by their first and last bytes before they are sorted."""
    first, last = ends_of(data, at, width)
    order = np.lexsort((last, first, bucket))
    b, f, e = bucket[order], first[order], last[order]
    head = np.ones(len(order), bool)
    head[1:] = (b[1:] != b[:-1]) | (f[1:] != f[:-1]) | (e[1:] != e[:-1])
    part = np.cumsum(head)
    alone = head & np.concatenate([head[1:], [True]])
    order, part = order[~alone], part[~alone]
    place, equal = sort_suffixes(data, prefix, at[order], part, width)
    return order[place[equal]]


def sort_contexts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Spans of the windows that an earlier context of the same anchor holds as well.

    Windows are worked on by their place before the anchor, about ``SORT_WINDOWS`` at a time.
    """
    for a, doc, tie, start, offset, content in groups_of(batches, 6, SORT_CONTEXTS):
        a, doc, tie, start, offset = (x.to_numpy() for x in (a, doc, tie, start, offset))
        # Rows come sorted by anchor, document, tie and start, and sorting keeps the order of equal suffixes.
        ends = np.frombuffer(content.buffers()[1], np.int32)[content.offset : content.offset + len(content) + 1].astype(np.int64)
        data = np.frombuffer(content.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        ends -= ends[0]
        prefix = prefix_hashes(data)
        n_windows = np.diff(ends) - width + 1
        group = np.cumsum(np.concatenate([[0], (a[1:] != a[:-1]).astype(np.int64)]))
        step = max(1, min(width, SORT_WINDOWS // len(a)))
        for low in range(0, width, step):
            # Places before the anchor from low on: the window begins at offset - place within its context.
            first = np.maximum(offset - low - step + 1, 0)
            n = np.clip(np.minimum(offset - low + 1, n_windows) - first, 0, None)
            of = np.repeat(np.arange(len(a)), n)
            inside = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]
            bucket = group[of] * 128 + (offset[of] - inside)
            repeated = repeated_windows(data, prefix, ends[:-1][of] + inside, bucket, width)
            d, s = doc[of[repeated]], start[of[repeated]] + inside[repeated]
            yield span_batch(*merged_spans(d, tie[of[repeated]], s, s + width))


def merged_runs(spans) -> list[list[int]]:
    """Maximal runs of a document's spans."""
    runs: list[list[int]] = []
    for s, e in sorted((s["start"], s["end"]) for s in spans):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    return runs


def apply_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal spans and the bytes outside of them."""
    for batch in sliced(batches):
        out = []
        for doc, text, spans in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3)], strict=True):
            runs = merged_runs(spans or ())
            edges = [0, *[x for r in runs for x in r], len(text)]
            kept = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
            out.append((None if doc == NO_ID else doc, len(text), [{"start": s, "end": e} for s, e in runs], kept))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = (pa.int64(), pa.int64(), span, pa.binary())
        columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)]
        yield pa.record_batch(columns, ["doc_id", "n_bytes", "spans", "kept"])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents as ``doc`` (id, the least number for null), ``tie`` (a hash of the text, 64 bits) and ``text`` in bytes."""
    return pick(docs, _id=id_col, _text=text_col).select(
        F.coalesce(F.col("_id").cast("bigint"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64("_text").alias("tie"),
        F.coalesce(F.col("_text").cast("binary"), F.lit(b"")).alias("text"),
    )


def repeated_spans(rows: DataFrame, width: int) -> DataFrame:
    """``doc``, ``tie``, ``spans`` (in bytes, they may overlap) of the ``keyed`` documents that hold repeated strings.

    Work grows with the number of anchors (about one in 35 bytes); copies are dropped where they are found. The different
    surroundings of one anchor meet in one task, and are worked on a slice at a time.
    """
    if width - ANCHOR > 126 or width <= ANCHOR:
        raise ValueError("width must lie between 33 and 158")
    found = in_arrow(rows, lambda b: find_anchors(b, width), "a long, c long, doc long, tie long, pos long, until long")
    dealt = found.repartition("a").sortWithinPartitions("a", "c", "doc", "tie", "pos")
    judged = stored(in_arrow(dealt, lambda b: judge_anchors(b, width), SPANS), "anchors")
    reps = judged.where(F.col("a").isNotNull()).groupBy("doc", "tie")
    reps = reps.agg(F.collect_list(F.struct("a", "start", "end", "offset")).alias("reps"))
    # Rows of the same id and text are one document here: each context once, or every window of it would repeat itself.
    sources = rows.join(reps.select("doc", "tie"), ["doc", "tie"], "left_semi").dropDuplicates(["doc", "tie"])
    contexts = sources.join(reps, ["doc", "tie"]).select("doc", "tie", "text", "reps")
    contexts = in_arrow(contexts, cut_contexts, "a long, doc long, tie long, start long, offset long, bytes binary")
    contexts = contexts.repartition("a").sortWithinPartitions("a", "doc", "tie", "start")
    more = in_arrow(contexts, lambda b: sort_contexts(b, width), SPANS)
    spans = judged.where(F.col("a").isNull()).unionByName(more).groupBy("doc", "tie")
    return spans.agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def find_repeats(docs: DataFrame, id_col: str, text_col: str, width: int = 100) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``spans`` (maximal removed runs, in bytes) and ``kept`` (the remaining bytes).

    One row for each row. A byte is removed if it lies in a string of ``width`` bytes that also starts in a document of smaller
    id, or earlier in the same one; strings are judged on the input. Null texts are empty; texts shorter than ``width`` stay.
    Rows of the same id and text are one document and keep the same bytes; rows of one id with other texts come
    one after the other by a hash of the text; null ids come first. An empty table gives no rows.
    """
    rows = keyed(docs, id_col, text_col)
    joined = rows.join(repeated_spans(rows, width), ["doc", "tie"], "left").select("doc", "tie", "text", "spans")
    return in_arrow(joined, apply_spans, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def without_spans(text: str | None, spans: list[dict] | None) -> str | None:
    """Text less the characters that lie in the spans with all their bytes."""
    if text is None or not spans:
        return text
    data = text.encode("utf-8", "surrogatepass")
    out, at = [], 0
    for s, e in merged_runs(spans):
        while s < e and data[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1
        out.append(data[at:s])
        at = e
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, id_col: str, text_col: str, width: int = 100) -> DataFrame:
    """``docs`` with the spans of ``find_repeats`` taken out of the text, but for characters that a span cuts; null texts stay null.

    One row for each row, all columns as they were, and ``repeated`` (whether the text had such spans; replaced if there already).
    """
    source = docs.drop("repeated")
    spans = repeated_spans(keyed(source, id_col, text_col), width)
    doc, tie, found = (fresh(n, source.columns) for n in ("_doc_key", "_tie_key", "_spans"))
    key = F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NO_ID)).alias(doc)
    rows = source.select("*", key, F.xxhash64(f"`{text_col}`").alias(tie))
    spans = spans.select(F.col("doc").alias(doc), F.col("tie").alias(tie), F.col("spans").alias(found))
    joined = rows.join(spans, [doc, tie], "left").select(*[F.col(f"`{c}`") for c in source.columns], found)
    place = source.columns.index(text_col)
    schema = T.StructType([*source.schema.fields, T.StructField("repeated", T.BooleanType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            columns = list(batch.columns)
            all_spans = columns.pop().to_pylist()
            texts = columns[place].to_pylist()
            columns[place] = pa.array([without_spans(t, s) for t, s in zip(texts, all_spans, strict=True)], pa.string())
            columns.append(pa.array([bool(s) for s in all_spans], pa.bool_()))
            yield pa.record_batch(columns, [*batch.schema.names[:-1], "repeated"])

    return in_arrow(joined, cut, schema)


SPANS = "doc long, tie long, start long, end long, a long, offset long"
