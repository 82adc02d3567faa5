import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from apisurface.llm import merkle_manifest as m
from apisurface.ordered import with_global_rank

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, size string"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, place):
    out = []
    for level in levels[:-1]:
        beside = (place ^ 1) < len(level)
        out.append((("left" if place & 1 else "right"), level[place ^ 1]) if beside else (None, None))
        place >>= 1
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, h(*map(framed, r[:5]))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [levels_of([leaf[2] for leaf in sorted(groups[g])]) for g in names]
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for i, g in enumerate(names):
        for place, (known, doc, leaf) in enumerate(sorted(groups[g])):
            out.append((doc if known else None, leaf, trees[i][-1][0], top[-1][0], path(trees[i], place) + path(top, i)))
    return out


def check(spark, rows, bits=m.PARTITION_BITS):
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA).repartition(3)
    built = m.build(df, "doc_id", "lang", m.leaf_digest([F.col(f) for f in FIELDS]), {"kept": F.col("size")})
    got = m.prove(built, ["kept"], bits).withColumn("folded", m.fold_proof(F.col("leaf"), F.col("proof"))).collect()
    shown = [(r["id"], r["leaf"], r["subroot"], r["root"], [(s["side"], s["digest"]) for s in r["proof"]]) for r in got]
    key = lambda t: str(t)
    assert sorted(shown, key=key) == sorted(brute(rows), key=key)
    assert all(r["folded"] == r["root"] and r["kept"] == "b" for r in got)
    return built


@pytest.mark.parametrize("bits", [13, 3])
def test_against_whole_trees(spark, monkeypatch, bits):
    monkeypatch.setattr(m, "BLOCK_BITS", 2)
    rng = random.Random(bits)
    rows = []
    for lang, n in (("en", 67), ("dé", 1), (None, 2), ("z", 5), ("", 16)):
        rows += [(rng.randrange(1000) if i % 9 else None, rng.choice(["s", None, ""]), lang, rng.choice([None, 3, 12]), rng.choice(["text", None, "", "é" * 5000])) for i in range(n)]
    check(spark, rows, bits)


def test_equal_rows_are_leaves_each_and_lone_leaves_have_empty_proofs(spark):
    check(spark, [(1, "s", "en", 3, "abc")] * 21)
    check(spark, [(1, "s", "en", 3, "abc")])
    check(spark, [(None, None, None, None, None)])


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    built = m.build(df, "doc_id", "lang", m.leaf_digest([F.col("text")]))
    assert built.root is None and m.prove(built).collect() == []
    assert m.manifest_digests(df, "doc_id", "lang", FIELDS).collect() == []


def test_missing_places_are_enough_and_none_too_many():
    rng = random.Random(2)
    for size in (1, 2, 3, 7, 8, 33, 100):
        leaves = [h(str(i)) for i in range(size)]
        levels = levels_of(leaves)
        for _ in range(12):
            places = sorted(rng.sample(range(size), rng.randint(1, size)))
            lacking = m.missing_places(np.array(places), size)
            # Whatever the leaves lead to is not asked for, and each node asked for is needed on some path.
            known = {(0, p) for p in places} | {(lv, p >> lv) for p in places for lv in range(len(levels))}
            needed = {(lv, (p >> lv) ^ 1) for p in places for lv in range(len(levels) - 1) if (p >> lv) ^ 1 < len(levels[lv])}
            assert set(lacking) == needed - known and len(lacking) == len(set(lacking))
            fetched = {(lv, p): levels[lv][p].encode() for lv, p in lacking}
            derived = m._derived({p: leaves[p].encode() for p in places}, size, fetched)
            assert derived[-1][0].decode() == levels[-1][0]


def test_a_changed_leaf_or_step_leads_elsewhere(spark):
    rows = [(i, "s", "en" if i % 3 else "de", i, f"text {i}") for i in range(30)]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    proofs = m.manifest_digests(df, "doc_id", "lang", FIELDS)
    other = F.sha2(F.lit("other").cast("binary"), 256)
    assert proofs.where(m.fold_proof(other, F.col("proof")) == F.col("root")).count() == 0
    swapped = F.transform("proof", lambda s: F.struct(F.when(s["side"] == "left", "right").otherwise("left").alias("side"), s["digest"].alias("digest")))
    assert proofs.where(m.fold_proof(F.col("leaf"), swapped) == F.col("root")).count() == 0


def test_a_wrong_node_is_noticed(spark):
    df = spark.createDataFrame([(i, "s", "en", i, f"text {i}", "a", "b") for i in range(40)], SCHEMA)
    built = m.build(df, "doc_id", "lang", m.leaf_digest([F.col("text")]))
    built.nodes = built.nodes.withColumn("digest", F.when(F.col("level") == 3, F.lit("0" * 64)).otherwise(F.col("digest")))
    with pytest.raises(Exception, match="multiproof leads to"):
        m.prove(built, bits=3).collect()


def test_global_rank(spark):
    rng = random.Random(1)
    values = [(rng.choice([None, 1, 2, 2, 2, rng.randrange(100)]), i) for i in range(500)]
    df = spark.createDataFrame(values, "v long, i long").repartition(7)
    got = with_global_rank(df, ["v", "i"]).collect()
    order = sorted(got, key=lambda r: r["rank"])
    assert [r["rank"] for r in order] == list(range(500))
    assert [(r["v"], r["i"]) for r in order] == sorted(values, key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
    assert with_global_rank(df.limit(0), ["v"]).collect() == []
