"""Unions, differences and closures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apisurface.session import cut_lineage


COMPACT_EVERY = 16


def combine_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both tables in one schema."""
    return a.unionByName(b)


def join_distinct_names(df: DataFrame, by: Sequence[str], name: str, order: Sequence[str], sep: str = "_", out: str = "name") -> DataFrame:
    """Distinct names of a group in order of first occurrence, joined.

    Every name is reduced to its first occurrence before names are collected.
    """
    first = df.groupBy(*by, name).agg(F.min(F.struct(*order)).alias("_first"))
    entries = F.sort_array(F.collect_list(F.struct(F.col("_first"), F.col(name).alias("_name"))))
    return first.groupBy(*by).agg(F.array_join(F.transform(entries, lambda e: e["_name"]), sep).alias(out))


def missing_items(required: DataFrame, present: DataFrame, keys: Sequence[str], sort: bool = True) -> DataFrame:
    """Required keys that are not present."""
    missing = required.join(present.select(*keys), list(keys), "left_anti")
    return missing.orderBy(*keys) if sort else missing


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


#: Rounds that follow the edges one by one, before stretches without branches are jumped over.
PLAIN_ROUNDS = 8


def _jumps(links: DataFrame, node: str) -> list[DataFrame]:
    """Pointers 1, 2, 4, ... steps ahead of every node with one successor, as far as such stretches reach; each a stored table."""
    single = links.groupBy(node).agg(F.min("_next").alias("_next"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 1)
    pointers = [cut_lineage(single.select(node, "_next"))]
    most = pointers[0].count().bit_length()
    while len(pointers) < most:
        last = pointers[-1]
        ahead = last.select(F.col(node).alias("_next"), F.col("_next").alias("_far"))
        longer = cut_lineage(last.join(ahead, "_next").select(node, F.col("_far").alias("_next")))
        if longer.isEmpty():
            break
        pointers.append(longer)
    return pointers


def reachable(edges: DataFrame, roots: DataFrame, src: str = "src", dst: str = "dst", node: str = "node") -> DataFrame:
    """Nodes reachable from the roots, roots included.

    Each round joins the frontier with the edges, which are computed once, and drops visited nodes. The
    new frontier is cut from its lineage in the shared checkpoint folder. The loop ends when nothing new
    appears, so cycles are allowed. Where it does not end soon, nodes with one successor get pointers of 1, 2, 4, ... steps: from
    the longest to the shortest each adds what it leads to, so a stretch without branches takes rounds as the logarithm of
    its length, and others as many as it has branches.
    """
    links = cut_lineage(edges.select(F.col(src).alias(node), F.col(dst).alias("_next")).where(F.col(dst).isNotNull()).distinct())
    frontier = cut_lineage(roots.select(F.col(roots.columns[0]).alias(node)).distinct())
    visited, rounds, pointers = frontier, 0, None
    while not frontier.isEmpty():
        if rounds >= PLAIN_ROUNDS:
            pointers = _jumps(links, node) if pointers is None else pointers
            start = frontier
            for jump in reversed(pointers):
                reached = jump.join(start, [node]).select(F.col("_next").alias(node))
                start = cut_lineage(start.unionByName(reached).distinct())
            # All of the stretches, but for what was known before.
            new = start.join(visited, node, "left_anti")
            frontier = cut_lineage(new.unionByName(frontier).distinct())
            visited = cut_lineage(visited.unionByName(new))
        found = links.join(frontier, [node]).select(F.col("_next").alias(node)).distinct()
        frontier = cut_lineage(found.join(visited, node, "left_anti"))
        visited, rounds = visited.unionByName(frontier), rounds + 1
        if rounds % COMPACT_EVERY == 0:
            visited = cut_lineage(visited)
    return visited
