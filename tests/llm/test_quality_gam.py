import random
import zlib

import numpy as np
import pytest

from apisurface.llm import quality_gam as q
from apisurface.llm.sampling import bounded_sample

SCHEMA = "doc_id long, text string, lang string, score string, predicted string"
WORDS = "the and that with from this which there their about would people time water place house".split()


def text_of(rng, good):
    words = [rng.choice(WORDS) + rng.choice(["", "s", "ing", "ly"]) for _ in range(rng.randint(20, 120))]
    if good:
        return "\n".join(" ".join(words[i : i + 9]).capitalize() + "." for i in range(0, len(words), 9))
    return rng.choice([" | ".join(words), "!! ".join(words).upper() + "!!", " ".join(w for w in words for _ in range(6))])


def corpus(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        rows.append((i, text_of(rng, good), int(good)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "old", "old") for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows], "doc_id long, quality int, text string")
    return docs, labels


def out_of_sample(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def plain_score(model, text):
    """Sigmoid of looked-up bins, one after the other."""
    x = q.describe(text)
    total = model.intercept
    for f, value in enumerate(x):
        total += model.tables[f][sum(e <= value for e in model.edges[f])]
    for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
        total += table[sum(e <= x[a] for e in model.pair_edges[a])][sum(e <= x[b] for e in model.pair_edges[b])]
    return 1 / (1 + np.exp(-total))


@pytest.fixture(scope="module")
def fitted(spark):
    rows = corpus(500)
    docs, labels = frames(spark, rows)
    return q.fit(docs, labels, "doc_id", "text", "quality"), rows, docs


def test_held_out_accuracy_and_plain_scores(fitted):
    model, rows, docs = fitted
    got = {r["doc_id"]: r for r in q.score(docs, "text", model).collect()}
    held = [r for r in rows if out_of_sample(r[0])]
    assert len(held) > 50
    assert sum(got[i]["predicted"] == y for i, _, y in held) / len(held) > 0.95
    for i, text, _ in rows[:150]:
        assert abs(got[i]["score"] - plain_score(model, text)) < 1e-12
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.3)


def test_edges(spark, fitted):
    model, _, _ = fitted
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "12 ?? 34"), (5, "the people " * 100_000), (6, "a" * 700_000), (None, "the water"), (5, "the people " * 100_000)]
    docs = spark.createDataFrame([(i, t, "en", "old", "old") for i, t in rows], SCHEMA)
    got = q.score(docs, "text", model)
    assert got.columns == ["doc_id", "text", "lang", "score", "predicted"]
    got = got.collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add(r["score"])
    assert by_id[1] == by_id[2] and all(len(s) == 1 for s in by_id.values())
    assert q.score(spark.createDataFrame([], SCHEMA), "text", model).collect() == []


def test_chunks_cover_whole_texts(monkeypatch):
    text = " ".join(corpus(40)[i][1] for i in range(40))
    monkeypatch.setattr(q, "CHUNK", 200)
    parts = list(q._chunks(text))
    assert "".join(parts) == text and max(map(len, parts)) <= 200 and len(parts) > 10
    kinds = dict(zip(q.FEATURES, q.describe(text), strict=True))
    assert abs(kinds["upper_share"] - sum(c.isupper() for c in text) / sum(c.isalpha() for c in text)) < 1e-12
    assert abs(kinds["word_length"] - sum(not c.isspace() for c in text) / len(text.split())) < 1e-12


def test_labels_that_say_nothing(spark):
    rows = corpus(60)
    docs, labels = frames(spark, rows)
    assert q.score(docs, "text", q.fit(docs, labels.limit(0), "doc_id", "text", "quality")).first()["score"] == 0.5
    one = q.fit(docs, labels.where("quality = 1"), "doc_id", "text", "quality")
    scores = {r["score"] for r in q.score(docs, "text", one).collect()}
    assert len(scores) == 1 and scores.pop() > 0.9
    odd = spark.createDataFrame([(None, 1), (3, None), (4, 7), (10**9, 1)], "doc_id long, quality int")
    assert q.fit(docs, odd, "doc_id", "text", "quality").intercept == 0.0


def test_sample_stays_in_its_bound_and_is_the_same_each_time(spark):
    hot = [(7, "the people", 1)] * 3000 + [(i, f"the water {i}", i % 2) for i in range(400)]
    docs = spark.createDataFrame([(i, t + str(k % 900), "en", "", "") for k, (i, t, _) in enumerate(hot)], SCHEMA)
    labels = spark.createDataFrame(sorted({(i, y) for i, _, y in hot}), "doc_id long, quality int")
    seen = []
    real = q.train

    def watched(x, y, settings):
        seen.append(len(y))
        return real(x, y, settings)

    q.train, kept = watched, q.train
    try:
        a, b = (q.fit(docs.repartition(n), labels.repartition(n), "doc_id", "text", "quality", q.Settings(sample_rows=50)) for n in (1, 5))
    finally:
        q.train = kept
    assert seen[0] == seen[1] <= 50
    assert a.intercept == b.intercept and all((x == y).all() for x, y in zip(a.tables, b.tables, strict=True))


def test_bounded_sample(spark):
    df = spark.range(5000).selectExpr("id % 2000 as k", "1 as one")
    got = [r["k"] for r in bounded_sample(df, 100, ["k"]).collect()]
    assert len(got) == len(set(got)) == 100
    assert bounded_sample(df, 3000, ["k"]).count() == 2000
    assert bounded_sample(df.limit(0), 10, ["k"]).count() == 0


def test_pairs_find_what_single_features_cannot():
    rng = np.random.default_rng(3)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = q.train(x, y)
    assert model.pairs[0] == (0, 1)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


def test_held_out_follows_the_id(spark):
    got = spark.range(60).select("id", q.held_out("id").alias("h")).collect()
    assert all(r["h"] == out_of_sample(r["id"]) for r in got)
