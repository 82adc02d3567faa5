import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from apisurface.llm import language_id

SCHEMA = "doc_id long, text string, lang string, score string, source string"
WORDS = {
    "en": "the and that with from this which there their about would".split(),
    "de": "der und nicht eine über schön werden können auch müssen".split(),
    "fr": "les des une été après leçon où même élève avec pour".split(),
}


def corpus(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randint(5, 60))), lang, "old", "s"))
    return rows


@pytest.fixture(scope="module")
def judged(spark):
    rows = corpus(400)
    odd = [(1000, None, "en", "old", "s"), (1001, "", None, "old", "s"), (1002, "12 34 .. !", "de", "old", "s"), (1003, "der und nicht " * 30000, None, "old", "s"), (None, "the and that", None, "old", "s"), (5, *rows[5][1:])]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    model = language_id.fit(df.where(~language_id.held_out("doc_id")), "doc_id", "text", "lang")
    return {(r["doc_id"], r["source"]): r for r in language_id.predict(df, "text", model).collect()}, rows, model


def test_held_out_accuracy(judged):
    found, rows, _ = judged
    import zlib

    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 50
    right = sum(found[r[0], "s"]["lang_pred"] == r[2] for r in held)
    assert right / len(held) > 0.95
    assert all(0 <= found[r[0], "s"]["score"] <= 1 and not found[r[0], "s"]["rejected"] for r in held)


def test_edges(judged):
    found, _, model = judged
    for key in (1000, 1001, 1002):
        assert tuple(found[key, "s"][c] for c in ("lang_pred", "score", "rejected")) == ("und", 0.0, True)
    assert found[1003, "s"]["lang_pred"] == "de"
    assert found[None, "s"]["lang_pred"] == "en"
    assert model.languages == ["de", "en", "fr"]


def test_columns_and_rows_are_kept(spark):
    df = spark.createDataFrame(corpus(20) * 2, SCHEMA)
    model = language_id.fit(df, "doc_id", "text", "lang")
    out = language_id.predict(df, "text", model)
    assert out.columns == ["doc_id", "text", "lang", "source", "lang_pred", "score", "rejected"]
    assert out.count() == 40


def test_same_model_for_any_partitioning(spark):
    df = spark.createDataFrame(corpus(60), SCHEMA)
    one, two = (language_id.fit(df.repartition(n), "doc_id", "text", "lang") for n in (1, 5))
    assert (one.table == two.table).all() and one.threshold == two.threshold


FOREIGN = [
    "все люди рождаются свободными и равными в своем достоинстве и правах",
    "人人生而自由 在尊严和权利上一律平等 他们赋有理性和良心",
    "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
    "qxz vkj wpfq zzxk jvq xqk wvz qpf kzx vjw xzq fkq",
]


def test_unlearned_languages_and_letter_junk_are_rejected(judged, spark):
    _, _, model = judged
    out = language_id.predict(spark.createDataFrame([(t,) for t in FOREIGN], "text string"), "text", model).collect()
    assert all(r["rejected"] and r["lang_pred"] in model.languages for r in out)


@pytest.mark.parametrize("known", [["en"], ["de", "en"]])
def test_few_languages_reject_as_well(spark, known):
    rows = [r for r in corpus(600) if r[2] in known]
    df = spark.createDataFrame(rows, SCHEMA)
    model = language_id.fit(df.where(~language_id.held_out("doc_id")), "doc_id", "text", "lang")
    out = language_id.predict(df, "text", model)
    assert out.where("rejected").count() == 0 and {r["lang_pred"] for r in out.collect()} == set(known)
    other = language_id.predict(spark.createDataFrame([(t,) for t in FOREIGN], "text string"), "text", model).collect()
    assert all(r["rejected"] for r in other)


def test_rejection_follows_the_held_back_scores():
    right, foreign = np.linspace(0.9, 1, 500), np.linspace(0, 0.4, 500)
    assert 0.4 < language_id.rejection(right, foreign, 0.002) < 0.9
    # Where the two meet, the share of the rows judged right decides, with no bound from the number of languages.
    mixed = np.linspace(0.8, 1, 500)
    assert abs(language_id.rejection(mixed, np.full(500, 0.95), 0.002) - np.quantile(mixed, 0.002)) < 1e-9


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    model = language_id.fit(df, "doc_id", "text", "lang")
    assert model.languages == [] and language_id.predict(df, "text", model).collect() == []
    rows = language_id.predict(spark.createDataFrame(corpus(3), SCHEMA), "text", model).collect()
    assert {r["lang_pred"] for r in rows} == {"und"}


def test_held_out_follows_the_id(spark):
    import zlib

    got = spark.range(50).select("id", language_id.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)
    assert spark.range(1).select(F.lit(None).cast("long").alias("id")).select(language_id.held_out("id").alias("h")).first()["h"] is False


def test_ties_stay_in_the_bound(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id, "train", lambda features, labels, settings: seen.append((features.shape[0], len(labels))))
    settings = language_id.Settings(sample_per_language=30)
    rows = [(None, f"the and that {i % 2}", "en", "", "") for i in range(20_000)]
    language_id.fit(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", "lang", settings)
    many = [(None, "the and that with " + "abcdefghij"[i % 10] * (1 + i % 97), "en", "", "") for i in range(5_000)]
    language_id.fit(spark.createDataFrame(many, SCHEMA), "doc_id", "text", "lang", settings)
    assert seen == [(2, 2), (30, 30)]


def plain_prediction(model, text):
    """Language and score by plain loops over the n-grams."""
    from collections import Counter

    data = language_id.clean(text)
    one = np.uint64(0x9E3779B97F4A7C15)
    cells = Counter()
    with np.errstate(over="ignore"):
        for n in model.settings.orders:
            for i in range(len(data) - n + 1):
                h = np.uint64(0)
                for byte in data[i : i + n]:
                    h = h * one + language_id.BYTE_VALUES[byte]
                cells[int(language_id.mix(np.array([h + np.uint64(n)]))[0]) % model.settings.buckets] += 1
    total = sum(cells.values())
    logits = [float(b) for b in model.bias]
    for cell, times in cells.items():
        for k in range(len(logits)):
            logits[k] += times * float(model.table[cell, k]) / total
    powers = [np.exp((v - max(logits)) / model.temperature) for v in logits]
    chances = [p / sum(powers) for p in powers]
    best = max(range(len(model.languages)), key=lambda k: (chances[k], -k))
    return model.languages[best], chances[best]


def test_predictions_against_plain_code(judged):
    found, rows, model = judged
    for i, text, *_ in rows[:60]:
        lang, score = plain_prediction(model, text)
        got = found[i, "s"]
        assert got["lang_pred"] == lang and abs(got["score"] - score) < 1e-5 and got["rejected"] == (score < model.threshold)
