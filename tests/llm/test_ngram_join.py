import random
import re

import pytest

from apisurface.llm import ngram_join
from apisurface.llm.components import connected_components

SCHEMA = "doc_id long, text string, n string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k, part, whole):
    sets = [shingles(t, k) for _, t in rows]
    parent = {d: d for d, _ in rows}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                shared = len(sets[i] & sets[j])
                if shared * whole >= part * len(sets[i] | sets[j]):
                    a, b = sorted((root(rows[i][0]), root(rows[j][0])))
                    parent[b] = a
    return sorted((d, len(s), root(d)) for (d, _), s in zip(rows, sets, strict=True))


def near_copies(rng, n_groups, size, words):
    vocabulary = ["".join(rng.choices("abcdeé", k=4)) for _ in range(300)]
    rows, doc = [], 0
    for _ in range(n_groups):
        base = rng.choices(vocabulary, k=rng.randint(*words))
        for _ in range(rng.randint(1, size)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((doc, rng.choice([" ", "\n", "\t "]).join(copy)))
            doc += 1
    return rows


@pytest.mark.parametrize("large", [64, 3])
def test_against_all_pairs(spark, monkeypatch, large):
    monkeypatch.setattr(ngram_join, "LARGE_BUCKET", large)
    rng = random.Random(large)
    rows = near_copies(rng, 25, 14, (1, 90))
    rng.shuffle(rows)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA).repartition(3)
    for k, part, whole in ((4, 85, 100), (5, 4, 5)):
        got = ngram_join.near_classes(df, "doc_id", "text", k, (part, whole)).collect()
        assert sorted(map(tuple, got)) == brute(rows, k, part, whole)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (6, "one two three four five"), (6, "one two three four five"), (None, "alone"), (8, "x " * 400)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    got = sorted(map(tuple, ngram_join.near_classes(df, "doc_id", "text").collect()), key=str)
    expected = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 2, 6), (6, 2, 6), (None, 1, None), (8, 1, 8)]
    assert got == sorted(expected, key=str)


def test_rows_of_one_id_are_one_node(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (2, "v w x y z"), (3, "v w x y z"), (4, "q")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    got = sorted(map(tuple, ngram_join.near_classes(df, "doc_id", "text").collect()))
    assert [r[2] for r in got] == [1, 1, 1, 1, 4]


def test_empty_table(spark):
    assert ngram_join.near_classes(spark.createDataFrame([], SCHEMA), "doc_id", "text").collect() == []


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(30)]
    got = dict(connected_components(spark.createDataFrame(links, "x long, y long")).collect())
    parent = {n: n for link in links for n in link}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for x, y in links:
        a, b = sorted((root(x), root(y)))
        parent[b] = a
    linked = {n for x, y in links if x != y for n in (x, y)}
    assert got == {n: root(n) for n in linked}


def complements(n):
    """Two words whose letters follow the Thue-Morse sequence and its complement."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_fool_a_polynomial_are_told_apart(spark):
    for n in (32, 64, 1024):
        a, b = complements(n)
        tail = " and some other words that follow here"
        rows = [(1, a), (2, b), (3, a + tail), (4, b + tail), (5, f"{a} {b}"), (6, f"{b} {a}")]
        df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
        assert sorted(map(tuple, ngram_join.near_classes(df, "doc_id", "text").collect())) == brute(rows, 4, 85, 100)


def test_very_long_texts(spark, monkeypatch):
    from apisurface.llm import shingles as s

    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 12))) for _ in range(5000)]
    words = rng.choices(vocabulary, k=150_000)
    text, other = " ".join(words), " ".join([*words[:70_000], "changed", *words[70_001:]])
    df = spark.createDataFrame([(1, text, "x"), (2, other, "x"), (3, "w" * 3_000_000, "x")], SCHEMA)
    assert sorted(r["component_id"] for r in ngram_join.near_classes(df, "doc_id", "text").collect()) == [1, 1, 3]
    whole = s.shingle_hashes(text.encode(), 4)
    monkeypatch.setattr(s, "PIECE", 1000)
    assert (s.shingle_hashes(text.encode(), 4) == whole).all()


def test_fragments_cut_the_global_order():
    import numpy as np

    rng = np.random.default_rng(1)
    hashes = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64) * np.uint64(2))
    frequent = hashes[::7]
    ranks = np.arange(len(frequent))[::-1].copy()
    order = ngram_join.ordered(hashes, frequent, ranks)
    fragments = ngram_join.fragment_of(order, frequent)
    assert (np.diff(fragments) >= 0).all() and set(fragments) == set(range(ngram_join.FRAGMENTS))
