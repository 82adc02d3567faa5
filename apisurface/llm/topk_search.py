"""Exact top-k search by inner product with two cover trees, one over data and one over queries.

Data vectors are dealt to cells around a bounded sample of pivots and cut into blocks; a task builds a cover tree
of a block, takes the queries sent to it in groups, builds a tree of each group, and walks both trees together. A pair of
nodes is left out if the largest inner product that their centres and covering radii allow is below the worst kth
score of the queries below the query node. Queries first search a block of their own cell; the kth scores found there
decide which other cells they must visit at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apisurface.llm.frames import pick, stored

#: Vectors of a block, at which a cell is cut; most pivots; queries of a group; points of a leaf.
BLOCK = 2048
PIVOTS = 256
QUERY_GROUP = 256
LEAF = 24
#: Below this all sums of products are exact in doubles.
EXACT = 2.0**53
NONE = -(1 << 63)


@dataclass
class Node:
    """A ball of points: the first one is its centre, ``radius`` covers all of them."""

    points: np.ndarray
    radius: float
    children: list[Node] = field(default_factory=list)
    centres: np.ndarray | None = None
    radii: np.ndarray | None = None


def cover_tree(points: np.ndarray) -> Node:
    """Cover tree of the rows of ``points``.

    A node of radius r has children of radius r/2 at most, whose centres are more than r/2 apart; its own
    centre is that of its first child. Few points, or equal ones, make a leaf.
    """

    def node(index: np.ndarray) -> Node:
        away = np.linalg.norm(points[index] - points[index[0]], axis=1)
        return Node(index, float(away.max()))

    root = node(np.arange(len(points)))
    todo = [root]
    while todo:
        top = todo.pop()
        if len(top.points) <= LEAF or top.radius == 0:
            continue
        left = top.points
        while len(left):
            near = np.linalg.norm(points[left] - points[left[0]], axis=1) <= top.radius / 2
            child = node(left[near])
            left = left[~near]
            top.children.append(child)
        top.centres = np.array([c.points[0] for c in top.children])
        top.radii = np.array([c.radius for c in top.children])
        todo.extend(top.children)
    return root


def upper_bound(product, data_norm, data_radius, query_norm, query_radius) -> np.ndarray:
    """Largest inner product of two points in balls whose centres have the given product and norms, rounding included."""
    reach = query_radius * data_norm + data_radius * (query_norm + query_radius)
    return product + reach + 1 + 1e-9 * (data_norm * query_norm + reach)


class Search:
    """Best ``keep`` data vectors of each query of a group, by score, then by smallest id."""

    def __init__(self, data: np.ndarray, ids: np.ndarray, tree: Node, queries: np.ndarray, bounds: np.ndarray, keep: int) -> None:
        self.data, self.ids, self.queries, self.keep = data, ids, queries, keep
        top = float(np.abs(data).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(data.shape[1], 1)
        # Beyond the exact range of doubles, scores are taken in 64-bit integers.
        self.exact = top < EXACT
        self.x, self.y = queries.astype(np.float64), data.astype(np.float64)
        self.norms = np.linalg.norm(self.y, axis=1)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
        self.worst = bounds.astype(np.float64)
        self.visit(cover_tree(self.x), tree)

    def scores(self, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        if self.exact:
            return (self.x[q] @ self.y[r].T).astype(np.int64)
        return self.queries[q] @ self.data[r].T

    def compare(self, q: np.ndarray, r: np.ndarray) -> None:
        """Score all pairs of two sets of points and keep the best."""
        scores = self.scores(q, r)
        for i in np.flatnonzero(scores.max(axis=1) >= self.worst[q]):
            query = q[i]
            good = np.flatnonzero(scores[i] >= self.worst[query])
            s = np.concatenate([self.best[query][0], scores[i, good]])
            at = np.concatenate([self.best[query][1], r[good]])
            order = np.lexsort((self.ids[at], -s))[: self.keep]
            self.best[query] = (s[order], at[order])
            if len(order) == self.keep:
                self.worst[query] = max(self.worst[query], float(s[order[-1]]))

    def visit(self, query_root: Node, data_root: Node) -> None:
        todo = [(query_root, data_root, np.inf)]
        while todo:
            q, r, bound = todo.pop()
            if bound < self.worst[q.points].min():
                continue
            if not r.children:
                if q.children:
                    todo.extend((c, r, bound) for c in q.children)
                else:
                    self.compare(q.points, r.points)
                continue
            centre = self.x[q.points[0]]
            most = upper_bound(self.y[r.centres] @ centre, self.norms[r.centres], r.radii, np.linalg.norm(centre), q.radius)
            open_ = most >= self.worst[q.points].min()
            points = open_ & (r.radii == 0)
            if points.any():
                self.compare(q.points, np.concatenate([r.children[i].points for i in np.flatnonzero(points)]))
            # The most promising child is taken next.
            for i in sorted(np.flatnonzero(open_ & ~points), key=lambda i: most[i]):
                child = r.children[i]
                if q.children and q.radius > child.radius:
                    todo.extend((c, child, np.inf) for c in q.children)
                else:
                    todo.append((q, child, most[i]))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def nearest(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Closest pivot of each vector, and its distance."""
    cell, least = np.zeros(len(vectors), np.int64), np.full(len(vectors), np.inf)
    for i, pivot in enumerate(pivots):
        away = np.linalg.norm(vectors - pivot, axis=1)
        closer = away < least
        cell[closer], least[closer] = i, away[closer]
    return cell, least


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the vectors of each length."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        yield int(n), np.flatnonzero(lengths == n)


@dataclass
class Cells:
    """Pivots by vector length; radius and number of blocks of each (length, cell)."""

    pivots: dict[int, np.ndarray]
    radius: dict[tuple[int, int], float] = field(default_factory=dict)
    blocks: dict[tuple[int, int], int] = field(default_factory=dict)


def assign(batches: Iterator[pa.RecordBatch], cells: Cells) -> Iterator[pa.RecordBatch]:
    """Vectors (v first) with length, cell and distance from its pivot."""
    for batch in batches:
        cell, away, length = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        for n, at in by_length(batch.column(0)):
            length[at] = n
            cell[at], away[at] = nearest(matrix(batch.column(0).take(pa.array(at))).astype(np.float64), cells.pivots.get(n, np.zeros((1, n))))
        columns = [*batch.columns, pa.array(length), pa.array(cell), pa.array(away)]
        yield pa.record_batch(columns, [*batch.schema.names, "length", "cell", "away"])


def send(batches: Iterator[pa.RecordBatch], cells: Cells, home_only: bool) -> Iterator[pa.RecordBatch]:
    """Queries (v, a, b, bound) to the blocks that they visit: one of their own cell at first, later all others that may hold more."""
    names = ["v", "ids", "a", "b", "bound", "length", "cell", "block", "kind"]
    keys = sorted(cells.blocks)
    for batch in batches:
        a = batch.column(1).to_numpy()
        bound = batch.column(3).to_numpy()
        for n, at in by_length(batch.column(0)):
            vectors = matrix(batch.column(0).take(pa.array(at))).astype(np.float64)
            pivots = cells.pivots.get(n, np.zeros((1, n)))
            home, _ = nearest(vectors, pivots)
            norms = np.linalg.norm(vectors, axis=1)
            for key in (k for k in keys if k[0] == n):
                blocks = cells.blocks[key]
                first = a[at] % blocks
                centre = pivots[key[1]]
                most = upper_bound(vectors @ centre, np.linalg.norm(centre), cells.radius[key], norms, 0.0)
                near = home == key[1] if home_only else most >= bound[at]
                for block in range(blocks):
                    there = (home == key[1]) & (first == block)
                    chosen = at[near & (there if home_only else ~there)]
                    for part in np.array_split(chosen, max(1, -(-len(chosen) // 5000))):
                        size = len(part)
                        if size:
                            rows = batch.take(pa.array(part))
                            whole = [pa.array(np.full(size, x, np.int64)) for x in (n, key[1], block, 1)]
                            none = pa.array([[]] * size, pa.list_(pa.int64()))
                            yield pa.record_batch([rows.column(0), none, *rows.columns[1:], *whole], names)


def search_blocks(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """Candidates of the queries of each block. Rows are sorted by block, a block's vectors come before its queries."""
    now, held, tree, data, ids = None, [], None, None, []

    def answers(rows: pa.RecordBatch) -> pa.RecordBatch:
        queries = matrix(rows.column(0))
        firsts = np.array([x[0] for x in ids], np.int64)
        found = Search(data, firsts, tree, queries, rows.column(4).to_numpy(), keep)
        out: list[tuple] = []
        for a, b, (scores, at) in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), found.best, strict=True):
            out.extend((a, b, i, int(s)) for s, p in zip(scores, at, strict=True) for i in ids[p])
        columns = [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)]
        return pa.record_batch(columns, ["a", "b", "vec_id", "score"])

    for batch in batches:
        marks = [batch.column(i).to_numpy() for i in (5, 6, 7, 8)]
        edges = np.flatnonzero(np.any([np.diff(m, prepend=m[:1]) != 0 for m in marks], axis=0)) if batch.num_rows else []
        cuts = [0, *edges, batch.num_rows]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            if begin == end:
                continue
            key, kind = tuple(int(m[begin]) for m in marks[:3]), int(marks[3][begin])
            part = batch.slice(begin, end - begin)
            if key != now:
                now, held, tree, data, ids = key, [], None, None, []
            if kind == 0:
                held.append(part)
                continue
            if tree is None and held:
                data = np.concatenate([matrix(p.column(0)) for p in held])
                ids = [x for p in held for x in p.column(1).to_pylist()]
                tree = cover_tree(data.astype(np.float64))
                held = []
            if tree is not None:
                for at in range(0, part.num_rows, QUERY_GROUP):
                    yield answers(part.slice(at, QUERY_GROUP))


def valid(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & F.coalesce(~odd, F.lit(False))


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = 10) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` best inner products of each query, ties to smaller ids.

    Both tables hold integer vectors under the same column names. A query is compared with every vector of its length but
    those of its own id; with fewer, all are given. Rows whose vector is null or holds a null take no part, as do null ids.
    Rows of equal id and vector count once. Equal vectors are searched once: only their ``k + 1`` smallest ids can
    be wanted, and those are found before the shuffle where they lie. Empty tables give no rows. Sums beyond 64 bits wrap.
    """
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        rows = pick(df, id=id_col, v=vector_col).select(F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<bigint>").alias("v"))
        return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(F.exists("v", lambda x: x.isNull()), F.lit(False)))

    keep = k + 1
    rows = usable(vectors)
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    distinct = rows.withColumn("place", place).where(F.col("place") <= keep)
    distinct = stored(distinct.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")), "vectors")
    n = distinct.count()
    lengths = distinct.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count")).limit(PIVOTS).collect()
    pivots = {}
    for row in lengths:
        wanted = max(1, min(PIVOTS * row["count"] // max(n, 1), -(-row["count"] // BLOCK)))
        sample = distinct.where(F.size("v") == row["n"]).orderBy(F.xxhash64("v"), "v").select("v").limit(wanted).collect()
        pivots[row["n"]] = np.array([r["v"] for r in sample], np.float64).reshape(len(sample), row["n"])
    cells = Cells(pivots)
    schema = "v array<bigint>, ids array<bigint>, length long, cell long, away double"
    placed = stored(distinct.mapInArrow(lambda b: assign(b, cells), schema), "cells")
    for r in placed.groupBy("length", "cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
        cells.radius[r["length"], r["cell"]] = r["radius"] * (1 + 1e-9) + 1e-6
        cells.blocks[r["length"], r["cell"]] = -(-r["n"] // BLOCK)
    sizes = F.broadcast(spark.createDataFrame([(*key, b) for key, b in cells.blocks.items()] or [(-1, -1, 1)], "length long, cell long, blocks long"))
    nothing = F.lit(None).cast("bigint")
    data = placed.join(sizes, ["length", "cell"]).select(
        "v", "ids", nothing.alias("a"), nothing.alias("b"), nothing.alias("bound"), "length", "cell",
        F.pmod(F.xxhash64("v"), F.col("blocks")).alias("block"), F.lit(0).cast("bigint").alias("kind"),
    )
    asked = usable(queries).dropDuplicates()
    asked = asked.select("id", "v", F.xxhash64("v").alias("a"), F.xxhash64(F.lit("query"), F.col("v")).alias("b"))
    distinct_asked = asked.dropDuplicates(["a", "b"]).select("v", "a", "b")

    def search(asked_with_bound: DataFrame, home_only: bool) -> DataFrame:
        sent = asked_with_bound.mapInArrow(lambda b: send(b, cells, home_only), data.schema)
        both = data.unionByName(sent).repartition("length", "cell", "block")
        both = both.sortWithinPartitions("length", "cell", "block", "kind", "a")
        return both.mapInArrow(lambda b: search_blocks(b, keep), "a long, b long, vec_id long, score long")

    best = Window.partitionBy("a", "b").orderBy(F.desc("score"), "vec_id")
    first = stored(search(distinct_asked.withColumn("bound", F.lit(NONE)), True), "found")
    kth = first.withColumn("place", F.row_number().over(best)).where(F.col("place") == keep).select("a", "b", F.col("score").alias("kth"))
    bounded = distinct_asked.join(kth, ["a", "b"], "left").select("v", "a", "b", F.coalesce("kth", F.lit(NONE)).alias("bound"))
    found = first.unionByName(search(bounded, False))
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= keep).drop("place")
    mine = asked.select(F.col("id").alias("query_id"), "a", "b")
    pairs = mine.join(found, ["a", "b"]).where(F.col("query_id") != F.col("vec_id"))
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def floored(vector: Column, scale: int) -> Column:
    """Each component times ``scale``, as double, rounded down; null if the vector is not valid."""
    return F.when(valid(vector), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))
