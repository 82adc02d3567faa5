import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from apisurface.llm import topk_search

SCHEMA = "vec_id long, embedding array<float>, n string"


def brute(rows, k):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.setdefault((i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)))
    out = []
    queries = [(i, v) for i, v in usable if i % 5 == 0]
    for q in {i for i, _ in queries}:
        best = {}
        for i, v in queries:
            if i == q:
                for j, w in usable:
                    if j != q and len(w) == len(v):
                        score = sum(x * y for x, y in zip(v, w, strict=True))
                        best[j] = max(score, best.get(j, score))
        top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out.extend((q, n + 1, j, s) for n, (j, s) in enumerate(top))
    return sorted(out)


def run(spark, rows, k=10):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA).repartition(3)
    df = df.select("vec_id", topk_search.floored(F.col("embedding"), 1024).alias("v"), "n")
    got = topk_search.top_k(df, df.where(F.col("vec_id") % 5 == 0), "vec_id", "v", k)
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("block", [2048, 40])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(topk_search, "BLOCK", block)
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(6, 8))
    rows = [(i, list(map(float, centres[i % 6] + rng.normal(size=8) * 0.2))) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(400, 460)]
    rows += [(i, list(map(float, np.round(rng.normal(size=8), 1)))) for i in range(460, 520)]
    random.Random(1).shuffle(rows)
    assert run(spark, rows) == brute(rows, 10)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]),
            (None, [1.0, 1.0]), (6, [1.0, 2.0, 3.0]), (7, []), (10, []), (15, [-1.5, 0.3]), (8, [1e30, 1.0])]
    small = [r for r in rows if r[0] != 8]
    assert run(spark, small) == brute(small, 10)
    assert run(spark, [(5, [1.0])]) == []
    assert run(spark, []) == []


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(2**20 + i), float(2**21 - i), 3.0]) for i in range(40)]
    assert run(spark, rows) == brute(rows, 10)


def test_tree_covers_and_separates():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(500, 4))
    todo, leaves = [topk_search.cover_tree(points)], []
    while todo:
        node = todo.pop()
        away = np.linalg.norm(points[node.points] - points[node.points[0]], axis=1)
        assert away.max() <= node.radius
        leaves.extend([] if node.children else node.points)
        centres = [c.points[0] for c in node.children]
        for i, c in enumerate(node.children):
            assert c.radius <= node.radius / 2
            assert all(np.linalg.norm(points[centres[i]] - points[o]) > node.radius / 2 for o in centres[:i])
        todo.extend(node.children)
    assert sorted(leaves) == list(range(500))
