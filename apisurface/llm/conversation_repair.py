"""Repair of conversations by weighted parsing of their rows.

A conversation is sound if the initials of its roles read ``(s?(ua)+)?``. Rows are kept (0), given another role (2) or deleted (3), and rows
without text may be inserted (2); blank and repeated rows must go, truncated ones that stay cost 1 more. The cheapest edits are
found by interval parsing: a span of rows has a cell for each nonterminal, holding the least (cost, audit) that turns the
span into it, and spans are combined bottom-up by their length under a grammar of two-part rules, closed under insertion on both sides.

Nonterminals: ``-`` a span of which nothing stays, ``s`` a system row, ``uu ua au aa`` an alternation by its first and last role, ``su sa``
such a one behind a system row. Any cut of a sound row of roles gives two of these, so spans of blocks can be combined as well:
a conversation longer than a block is parsed within blocks, and then over neighbouring blocks, pair by pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apisurface.llm.frames import in_arrow, pick, sliced, stored

BLANKS = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
LEGAL_PAIRS = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}
OTHER = {"u": "a", "a": "u"}
#: Rows of a conversation that are parsed over all their spans; longer ones are cut.
BLOCK = 24
#: Parses a worker remembers, by the kinds of the rows of a block.
REMEMBERED = 50_000
#: Conversations of more rows look for repeats by sorting digests in place of a set.
MANY_ROWS = 4096

Cell = dict[str, tuple[int, str]]


def _grammar() -> list[tuple[str, str, str]]:
    """Rules (left, right, whole)."""
    ends = "ua"
    names = ["s", *[x + y for x in ends for y in ends], "su", "sa"]
    rules = [("-", "-", "-")] + [("-", n, n) for n in names] + [(n, "-", n) for n in names]
    for z in ends:
        for y in ends:
            rules.append((f"s{z}", OTHER[z] + y, f"s{y}"))
            rules += [(x + z, OTHER[z] + y, x + y) for x in ends]
    return rules + [("s", f"u{y}", f"s{y}") for y in ends]


RULES = _grammar()
INSERTED: Cell = {"uu": (INSERT_COST, INSERT), "aa": (INSERT_COST, INSERT)}


def combine(left: Cell, right: Cell, into: Cell) -> bool:
    """Enter what the neighbours ``left`` and ``right`` make into ``into`` where it is less; whether anything was."""
    better = False
    for a, b, whole in RULES:
        x, y = left.get(a), right.get(b)
        if x is None or y is None:
            continue
        cost, now = x[0] + y[0], into.get(whole)
        if now is None or cost < now[0] or (cost == now[0] and x[1] + y[1] < now[1]):
            into[whole] = (cost, x[1] + y[1])
            better = True
    return better


def close(cell: Cell) -> Cell:
    """``cell`` with what insertions before and behind its span make of it."""
    while combine(INSERTED, dict(cell), cell) | combine(dict(cell), INSERTED, cell):
        pass
    return cell


def row_cell(kind: str) -> Cell:
    """Cell of one row: ``x`` must go, else its initial (``o`` if it is none of s, u, a), in upper case if truncated."""
    cell: Cell = {"-": (DELETE_COST, DELETE)}
    if kind != "x":
        more, initial = (TRUNCATED_COST if kind.isupper() else 0), kind.lower()
        for role in ROLES:
            cell[role * 2] = (0 + more, KEEP) if role == initial else (REROLE_COST + more, REROLE)
        if initial == "s":
            cell["s"] = (more, KEEP)
    return close(cell)


def parse(kinds: str) -> Cell:
    """Cell of a whole row of kinds, over all spans and all their cuts."""
    spans = {(i, i + 1): row_cell(k) for i, k in enumerate(kinds)}
    for length in range(2, len(kinds) + 1):
        for start in range(len(kinds) - length + 1):
            end = start + length
            cell: Cell = {}
            for middle in range(start + 1, end):
                combine(spans[start, middle], spans[middle, end], cell)
            spans[start, end] = close(cell)
    return spans[0, len(kinds)]


_REMEMBERED: dict[str, Cell] = {}


def _remembered(kinds: str) -> Cell:
    found = _REMEMBERED.get(kinds)
    if found is None:
        found = parse(kinds)
        if len(_REMEMBERED) < REMEMBERED:
            _REMEMBERED[kinds] = found
    return found


def cheapest(kinds: str, block: int = BLOCK) -> tuple[int, str]:
    """Cost and audit of the cheapest edits; of equal costs the audit that is least in ASCII."""
    if not kinds:
        return 0, ""
    cells = [_remembered(kinds[i : i + block]) for i in range(0, len(kinds), block)]
    while len(cells) > 1:
        paired = []
        for i in range(0, len(cells) - 1, 2):
            cell: Cell = {}
            combine(cells[i], cells[i + 1], cell)
            paired.append(close(cell))
        cells = paired + cells[len(paired) * 2 :]
    return min(cells[0][name] for name in ("-", "ua", "sa") if name in cells[0])


def _digest() -> F.Column:
    """128 bits that stand for role and text."""
    said = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return F.unhex(F.md5(said.cast("binary"))).alias("digest")


def slim_rows(rows: DataFrame) -> DataFrame:
    """What the parse needs of each row of ``id, turn, role, text, gone``."""
    bare = F.rtrim("text", F.lit(BLANKS))
    return rows.select(
        "id",
        "turn",
        "role",
        _digest(),
        F.substring("role", 1, 1).alias("initial"),
        (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open"),
        "gone",
    )


#: The rows of a conversation follow their turns, null first, then role, then the digest of role and text.
ORDER = ("turn", "role", "digest")


class _Rows:
    """What is gathered of one conversation: a few bytes a row."""

    def __init__(self, key) -> None:
        self.key = key
        self.initials: list[str] = []
        self.digests = bytearray()
        self.marks = bytearray()
        self.least = self.most = self.last = None
        self.different = 0

    def add(self, turn, digest: bytes, initial: str, blank: bool, open_end: bool) -> None:
        self.initials.append(initial)
        self.digests += digest
        self.marks.append(2 if blank else int(open_end))
        if turn is not None:
            if turn != self.last:
                self.different += 1
                self.last = turn
            self.least = turn if self.least is None else self.least
            self.most = turn

    def repeated(self) -> list[bool]:
        n = len(self.initials)
        if n > MANY_ROWS:
            halves = np.frombuffer(bytes(self.digests), np.uint64).reshape(n, 2)
            order = np.lexsort((np.arange(n), halves[:, 1], halves[:, 0]))
            same = (halves[order][1:] == halves[order][:-1]).all(1)
            again = np.zeros(n, bool)
            again[order[1:]] = same
            return again.tolist()
        seen: set[bytes] = set()
        again = []
        for i in range(n):
            digest = bytes(self.digests[16 * i : 16 * i + 16])
            again.append(digest in seen)
            seen.add(digest)
        return again

    def result(self) -> tuple:
        counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        kinds = []
        for initial, mark, again in zip(self.initials, self.marks, self.repeated(), strict=True):
            kind = initial if initial in ("s", "u", "a") else "o"
            if mark == 2:
                counts["blank"] += 1
                kind = "x"
            elif again:
                counts["duplicate"] += 1
                kind = "x"
            elif mark == 1:
                counts["truncated"] += 1
                kind = kind.upper()
            kinds.append(kind)
        illegal = sum(x + y not in LEGAL_PAIRS for x, y in zip(self.initials, self.initials[1:], strict=False))
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.different
        return (self.key, gaps, *counts.values(), illegal, *cheapest("".join(kinds)))


PLAN = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def plan_repairs(rows: DataFrame) -> DataFrame:
    """One row for each ``id``: ``gaps, blank, duplicate, truncated, illegal, cost`` (long) and ``audit``; rows that are ``gone`` only name their id.

    Rows come sorted to the task of their conversation, which keeps about 20 bytes of each.
    """
    slim = slim_rows(rows)
    dealt = slim.repartition("id").sortWithinPartitions("id", *ORDER)
    fields = [slim.schema["id"], *[T.StructField(c, T.StringType() if c == "audit" else T.LongType()) for c in PLAN]]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, key_type = None, None

        def told(done: list[_Rows]) -> pa.RecordBatch:
            columns = list(zip(*[d.result() for d in done], strict=True))
            arrays = [pa.array(columns[0], key_type), *[pa.array(c, pa.int64()) for c in columns[1:-1]], pa.array(columns[-1], pa.string())]
            return pa.record_batch(arrays, ["id", *PLAN])

        for batch in sliced(batches, 10_000):
            key_type = batch.schema.field(0).type
            done = []
            columns = [batch.column(c).to_pylist() for c in ("id", "turn", "digest", "initial", "blank", "open", "gone")]
            for key, turn, digest, initial, blank, open_end, gone in zip(*columns, strict=True):
                if current is None or key != current.key:
                    if current is not None:
                        done.append(current)
                    current = _Rows(key)
                if not gone:
                    current.add(turn, digest, initial, blank, open_end)
            if done:
                yield told(done)
        if current is not None:
            yield told([current])

    return in_arrow(dealt, judge, T.StructType(fields))


def repair_rows(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired conversations: ``id, place, role, text, edit``, a row for each kept, renamed or inserted one.

    Each task streams whole conversations, the plan ahead of the rows, and holds one audit; the rows of a conversation lie in
    one partition, in order, which ``digests_in_order`` builds on.
    """
    body = rows.where(~F.col("gone")).select("id", F.lit(1).alias("seq"), "turn", "role", _digest(), "text")
    turn_type = rows.schema["turn"].dataType
    head = plans.select(
        "id",
        F.lit(0).alias("seq"),
        F.lit(None).cast(turn_type).alias("turn"),
        F.lit("").alias("role"),
        F.lit(None).cast("binary").alias("digest"),
        F.col("audit").alias("text"),
    )
    dealt = head.unionByName(body).repartition("id").sortWithinPartitions("id", "seq", *ORDER)
    schema = T.StructType(
        [
            rows.schema["id"],
            T.StructField("place", T.LongType()),
            T.StructField("role", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("edit", T.StringType()),
        ]
    )

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, at, place, wanted, key_type = None, "", 0, 0, "u", None
        out: list[tuple] = []

        def say(role: str | None, text: str, letter: str) -> None:
            nonlocal place, wanted
            if role is None:
                role = ROLES[wanted]
            if role[:1] != "s":
                wanted = OTHER[role[0]]
            out.append((key, place, role, text, letter))
            place += 1

        def insert() -> None:
            nonlocal at
            while audit[at : at + 1] == INSERT:
                say(None, "", INSERT)
                at += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            kinds = (key_type, pa.int64(), pa.string(), pa.string(), pa.string())
            made = pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema.names)
            out.clear()
            return made

        for batch in sliced(batches, 1000):
            key_type = batch.schema.field(0).type
            columns = [batch.column(c).to_pylist() for c in ("id", "seq", "role", "text")]
            for owner, seq, role, text in zip(*columns, strict=True):
                if seq == 0:
                    insert()
                    key, audit, at, place, wanted = owner, text, 0, 0, "u"
                    continue
                insert()
                letter = audit[at]
                at += 1
                if letter != DELETE:
                    say(role if letter == KEEP else None, text, letter)
            if out:
                yield flush()
        insert()
        if out:
            yield flush()

    return in_arrow(dealt, edit, schema)


def digests_in_order(repaired: DataFrame) -> DataFrame:
    """``id`` and ``sha256`` of the lines ``role:text``, joined by newlines, of each conversation of ``repair_rows``, hashed as they stream by."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, key_type = None, None, None

        def told(done: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([d[0] for d in done], key_type), pa.array([d[1].hexdigest() for d in done])], ["id", "sha256"])

        for batch in sliced(batches, 1000):
            key_type = batch.schema.field(0).type
            done = []
            columns = [batch.column(c).to_pylist() for c in ("id", "place", "role", "text")]
            for owner, place, role, text in zip(*columns, strict=True):
                line = f"{role}:{text}".encode("utf-8", "surrogatepass")
                if place == 0:
                    if state is not None:
                        done.append((key, state))
                    key, state = owner, hashlib.sha256(line)
                else:
                    state.update(b"\n" + line)
            if done:
                yield told(done)
        if state is not None:
            yield told([(key, state)])

    fields = [repaired.schema["id"], T.StructField("sha256", T.StringType())]
    return in_arrow(repaired.select("id", "place", "role", "text"), hashed, T.StructType(fields))


def repair(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, gone: F.Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Plans (one row for each id) and repaired rows of the conversations in ``rows``.

    Null role and text count as one space; null turns come first; a null id is a conversation of its own. Rows of equal turn follow role
    and digest, so repeated rows stand together and all but the first are duplicates. A role that starts with none of s, u, a, the
    empty one included, can be renamed or deleted, not kept. Rows where ``gone`` holds only make their id known. A conversation without
    rows costs nothing and has an empty audit. Very long texts are moved once, not gathered; very long conversations are parsed by blocks.
    An empty table gives no rows. Other columns, whatever their names, are left behind.
    """
    flag = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))
    named = pick(rows.withColumn("_gone", flag), id=id_col, turn=turn_col, role=role_col, text=text_col, gone="_gone")
    named = named.withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})
    plans = stored(plan_repairs(named), "plans")
    return plans, repair_rows(named, plans)
