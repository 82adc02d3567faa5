"""A Merkle tree over the rows of a dataset, with proofs of all rows by multiproofs.

Rows of one group, in the order of their ids, are the leaves of a tree; the roots of the groups are the leaves of a tree of
their own, whose root stands for the dataset. Blocks of leaves are folded by many tasks, then blocks of their roots, until one
node remains. Proofs come by octopus: each partition of leaves, groups mixed, works out the least set of node coordinates that its leaves and
what follows from them lack, fetches these once, derives all interiors that its proofs share, and expands the proof of each leaf
from them without asking again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apisurface.llm.frames import pick, stored
from apisurface.ordered import with_global_rank

#: A task folds at most 2^12 leaves of one tree at a time.
BLOCK_BITS = 12
#: Leaves, in the order of the dataset, that share one multiproof.
PARTITION_BITS = 13
#: The tree over the roots of all groups.
TOP = -1
NODE = "tree long, level int, place long, digest string"
PROOF = "array<struct<side:string,digest:string>>"


def framed(value: Column) -> Column:
    """A field as it is hashed: ``-`` for null, else its length in UTF-8 bytes, a colon and its text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of the framed fields, one behind the other; never null."""
    return F.sha2(F.concat(*[framed(f) for f in fields]).cast("binary"), 256)


def fold_proof(leaf: Column, proof: Column) -> Column:
    """The root that a leaf digest and its proof lead to; each step names the side its sibling stands on, null without sibling."""
    return F.aggregate(
        proof,
        leaf,
        lambda h, s: F.sha2(
            F.when(s["side"] == "left", F.concat(s["digest"], h)).when(s["side"] == "right", F.concat(h, s["digest"])).otherwise(h).cast("binary"),
            256,
        ),
    )


def digest(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def height(size: int) -> int:
    """Levels above the leaves of a tree of ``size`` leaves."""
    return (size - 1).bit_length()


def at_level(size: int, level: int) -> int:
    """Nodes of a level of a tree of ``size`` leaves."""
    return -(-size >> level)


def missing_places(places: np.ndarray, size: int) -> list[tuple[int, int]]:
    """The least set of (level, place) that, with the leaves at ``places``, gives all nodes on the paths from these to the root."""
    found = []
    known = np.unique(places)
    for level in range(height(size)):
        beside = known ^ 1
        lacking = beside[(beside < at_level(size, level)) & ~np.isin(beside, known, assume_unique=True)]
        found += [(level, int(p)) for p in lacking]
        known = np.unique(known >> 1)
    return found


@dataclass
class Manifest:
    """``leaves``: tree, place, size of the tree, rank, leaf digest and what was given to be kept; ``nodes``: every node of every tree, level 0 included."""

    leaves: DataFrame
    nodes: DataFrame
    trees: int
    root: str | None


def _folded(leaves: DataFrame, most: int) -> DataFrame:
    """All nodes above the leaves (``tree, place, digest, size``), whose trees have at most ``most`` leaves."""

    def fold(block: pa.Table) -> pa.Table:
        level = block.column("level")[0].as_py()
        tree = block.column("tree")[0].as_py()
        size = at_level(block.column("size")[0].as_py(), level)
        block = block.sort_by("place")
        first = block.column("place")[0].as_py()
        nodes = [d.encode() for d in block.column("digest").to_pylist()]
        levels, places, digests = [], [], []
        for up in range(level + 1, level + BLOCK_BITS + 1):
            if size == 1:
                break
            nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
            first, size = first >> 1, -(-size >> 1)
            levels += [up] * len(nodes)
            places += range(first, first + len(nodes))
            digests += nodes
        n = len(levels)
        columns = [pa.array([tree] * n, pa.int64()), pa.array(levels, pa.int32()), pa.array(places, pa.int64())]
        columns += [pa.array([d.decode() for d in digests], pa.string()), pa.array([block.column("size")[0].as_py()] * n, pa.int64())]
        return pa.table(columns, names=["tree", "level", "place", "digest", "size"])

    shape = f"{NODE}, size long"
    current = leaves.select("tree", F.lit(0).alias("level"), "place", "digest", "size")
    made = []
    for level in range(0, max(height(most), 1), BLOCK_BITS):
        block = F.shiftright("place", BLOCK_BITS)
        made.append(stored(current.groupBy("tree", block.alias("block")).applyInArrow(fold, shape), "nodes"))
        current = made[-1].where(F.col("level") == level + BLOCK_BITS)
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def build(rows: DataFrame, id_col: str, group_col: str, leaf: Column, keep: dict[str, Column] | None = None) -> Manifest:
    """The trees over ``rows``: one for each value of ``group_col`` (null is one of its own and comes first), its leaves by id.

    Null ids come first; rows of equal id follow the order of their leaf digests, and equal rows are leaves each. ``keep`` adds
    columns to the leaves under names of its own. Long texts are hashed in the JVM and go no further. Ranks are found by ranges of the
    whole order, with a salt for equal rows, so no group, id or row need fit a task. Without rows there is no node and no root.
    """
    kept = dict(keep or {})
    told = rows.select(
        F.col(f"`{group_col}`").alias("group"), F.col(f"`{id_col}`").alias("id"), leaf.alias("digest"), *[c.alias(n) for n, c in kept.items()], F.rand(7).alias("_salt")
    )
    ranked = stored(with_global_rank(told, ["group", "id", "digest", "_salt"]).drop("_salt"), "leaves")
    groups = ranked.groupBy("group").agg(F.min("rank").alias("begin"), F.count(F.lit(1)).alias("size"))
    groups = stored(with_global_rank(groups, ["begin"], "tree"), "groups")
    most = groups.agg(F.max("size"), F.count(F.lit(1))).first()
    named = groups.select(F.col("group").alias("_group"), "begin", "size", "tree")
    leaves = ranked.join(named, ranked["group"].eqNullSafe(named["_group"])).select(
        "tree", (F.col("rank") - F.col("begin")).alias("place"), "size", "rank", "id", "digest", *kept
    )
    leaves = stored(leaves, "leaves")
    above = _folded(leaves, most[0] or 1)
    node = ["tree", "level", "place", "digest"]
    bottom = leaves.select("tree", F.lit(0).alias("level"), "place", "digest", "size")
    every = bottom.unionByName(above)
    # The root of a tree is the only node of its level.
    levels = F.when(F.col("size") == 1, 0).otherwise(F.length(F.bin(F.col("size") - 1)))
    roots = every.where(F.col("level") == levels)
    roots = roots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), "digest", F.lit(most[1]).cast("long").alias("size"))
    roots = stored(roots, "roots")
    top = roots.select("tree", F.lit(0).alias("level"), "place", "digest", "size").unionByName(_folded(roots, most[1]))
    root = top.where(F.col("level") == height(most[1])).select("digest").first() if most[1] else None
    return Manifest(leaves, every.select(*node).unionByName(top.select(*node)), most[1], root["digest"] if root else None)


def requests(manifest: Manifest, bits: int = PARTITION_BITS) -> DataFrame:
    """The coordinates each partition of 2^``bits`` leaves lacks: ``part``, ``tree``, ``level``, ``place``, each once."""
    trees = manifest.trees

    def lacking(part: pa.Table) -> pa.Table:
        tree, place, size = (part.column(c).to_numpy() for c in ("tree", "place", "size"))
        out = [(TOP, *m) for m in missing_places(tree, trees)]
        for t in np.unique(tree):
            mine = tree == t
            out += [(int(t), *m) for m in missing_places(place[mine], int(size[mine][0]))]
        columns = list(zip(*out, strict=True)) if out else [[]] * 3
        kinds = (pa.int64(), pa.int32(), pa.int64())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.table([pa.array([part.column("part")[0].as_py()] * len(out), pa.int64()), *arrays], ["part", "tree", "level", "place"])

    slim = manifest.leaves.select(F.shiftright("rank", bits).alias("part"), "tree", "place", "size")
    return slim.groupBy("part").applyInArrow(lacking, "part long, tree long, level int, place long")


def _derived(known: dict[int, bytes], size: int, fetched: dict[tuple[int, int], bytes]) -> list[dict[int, bytes]]:
    """All nodes that leaves and fetched nodes give, a dict from place to digest for each level; fetched ones included."""
    levels = []
    for level in range(height(size)):
        here = dict(known)
        known = {}
        for place in list(here):
            up = place >> 1
            if up in known:
                continue
            pair = []
            for p in (up * 2, up * 2 + 1):
                if p not in here and p < at_level(size, level):
                    here[p] = fetched[level, p]
                if p in here:
                    pair.append(here[p])
            known[up] = digest(*pair)
        levels.append(here)
    levels.append(known)
    return levels


def _steps(place: int, size: int, levels: list[dict[int, bytes]]) -> Iterable[tuple[str | None, bytes | None]]:
    for level in range(height(size)):
        beside = (place >> level) ^ 1
        if beside >= at_level(size, level):
            yield None, None
        else:
            yield ("left" if beside & 1 == 0 else "right"), levels[level][beside]


def prove(manifest: Manifest, keep: Sequence[str] = (), bits: int = PARTITION_BITS) -> DataFrame:
    """Each leaf with its proof: ``id``, ``leaf``, ``subroot``, ``root``, ``proof`` (siblings from the leaf up, through the root of its group) and ``keep``.

    A level without sibling is a step without side. A partition is 2^``bits`` leaves and the nodes it fetched; both are bounded whatever
    the data. A partition whose nodes do not lead to the root of the manifest raises an error. A lone leaf has an empty proof.
    """
    wanted = requests(manifest, bits)
    fetched = wanted.join(manifest.nodes, ["tree", "level", "place"]).select("part", "tree", "level", "place", "digest")
    leaves = manifest.leaves.select(F.shiftright("rank", bits).alias("part"), "tree", "place", "size", "id", "digest", *keep)
    id_type = dict(leaves.dtypes)["id"]
    kept_types = [(c, dict(leaves.dtypes)[c]) for c in keep]
    trees, expected = manifest.trees, (manifest.root or "").encode()

    def expand(mine: pa.Table, others: pa.Table) -> pa.Table:
        got: dict[int, dict[tuple[int, int], bytes]] = {}
        for tree, level, place, d in zip(*[others.column(c).to_pylist() for c in ("tree", "level", "place", "digest")], strict=True):
            got.setdefault(tree, {})[level, place] = d.encode()
        places: dict[int, dict[int, bytes]] = {}
        sizes = {}
        told = [mine.column(c).to_pylist() for c in ("tree", "place", "size", "digest")]
        for tree, place, size, d in zip(*told, strict=True):
            places.setdefault(tree, {})[place] = d.encode()
            sizes[tree] = size
        derived = {t: _derived(known, sizes[t], got.get(t, {})) for t, known in places.items()}
        top = _derived({t: levels[-1][0] for t, levels in derived.items()}, trees, got.get(TOP, {}))
        if top[-1][0] != expected:
            raise ValueError(f"multiproof leads to {top[-1][0].decode()}, the manifest has {expected.decode()}")
        ending = {t: list(_steps(t, trees, top)) for t in derived}
        sides, digests, ends = [], [], [0]
        for tree, place in zip(told[0], told[1], strict=True):
            for side, d in (*_steps(place, sizes[tree], derived[tree]), *ending[tree]):
                sides.append(side)
                digests.append(d)
            ends.append(len(sides))
        steps = pa.StructArray.from_arrays([pa.array(sides, pa.string()), pa.array(digests, pa.binary()).cast(pa.string())], ["side", "digest"])
        subroots = pa.array([derived[t][-1][0].decode() for t in told[0]], pa.string())
        roots = pa.array([expected.decode()] * mine.num_rows, pa.string())
        proofs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)
        return pa.table(
            [mine.column("id"), mine.column("digest"), subroots, roots, proofs, *[mine.column(c) for c in keep]],
            ["id", "leaf", "subroot", "root", "proof", *keep],
        )

    shape = f"id {id_type}, leaf string, subroot string, root string, proof {PROOF}" + "".join(f", `{c}` {t}" for c, t in kept_types)
    return leaves.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(expand, shape)


def manifest_digests(rows: DataFrame, id_col: str, group_col: str, fields: Sequence[str]) -> DataFrame:
    """``id``, ``leaf``, ``subroot``, ``root``, ``proof`` for each row of ``rows``, its leaf made of ``fields``."""
    source = pick(rows, **{f"f{i}": f for i, f in enumerate(fields)}, _id=id_col, _group=group_col)
    return prove(build(source, "_id", "_group", leaf_digest([F.col(f"f{i}") for i in range(len(fields))])))
