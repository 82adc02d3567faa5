import random

import corpus_pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer

from apisurface.llm import suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ENGLISH = "the and that with from this which there their about would people time water place".split()
GERMAN = "der und nicht eine über schön werden können auch müssen zeit wasser leute jahre".split()


def prose(rng, words, n):
    """Invented sentences, one to a line."""
    made = ["".join(rng.choices(words, k=2)) if rng.random() < 0.7 else rng.choice(words) for _ in range(n)]
    return "\n".join(" ".join(made[i : i + 10]) + "." for i in range(0, n, 10))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = [(i, prose(rng, ENGLISH if i % 2 else GERMAN, 80), "en" if i % 2 else "de", "s") for i in range(80)]
    copy = rows[3][1]
    # A near copy of a text without line breaks, which line dedup does not touch.
    plain = prose(rng, ENGLISH, 120).replace("\n", " ")
    words = plain.split(" ")
    words[7], words[60] = "changed", "words"
    rows += [(100, copy, "en", "s"), (90, plain, "en", "s"), (101, " ".join(words), None, "s"), (102, None, None, "s"), (103, "12 !! 34", "en", "s"), (104, "", None, None)]
    passage = rows[9][1].replace("\n", " ")[100:400]
    rows += [(105, prose(rng, ENGLISH, 60) + " " + passage + " " + prose(rng, ENGLISH, 40), "en", None)]
    path = tmp_path_factory.mktemp("tables")
    df = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], SCHEMA)
    df.write.parquet(f"{path}/documents.parquet")
    return str(path), rows, passage


def test_stages_keep_columns_and_clean_documents(spark, folder):
    path, rows, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    clean = set(range(80)) | {90, 105}
    assert set(kept["language_id"]) == clean | {100, 101}
    assert 100 not in kept["line_dedup"] and clean <= set(kept["line_dedup"])
    assert set(kept["ngram_join"]) == clean
    assert passage not in kept["suffix_dedup"][105]["text"] and set(kept["suffix_dedup"]) == clean
    assert all(r["n_chars"] == len(r["text"]) for r in kept["suffix_dedup"].values())


def joined(spark, rows):
    df = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in rows], SCHEMA).repartition(3)
    out = corpus_pipeline.join_ngrams(spark, df, "")
    assert out.columns == df.columns
    return sorted(((r["doc_id"], r["text"], r["lang"]) for r in out.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def near(text, word=50):
    words = text.split()
    return " ".join([*words[:word], "changed", *words[word + 1 :]])


def test_null_ids_are_rows_of_their_own(spark):
    rng = random.Random(6)
    a, b, c, d = (prose(rng, ENGLISH, 120) for _ in range(4))
    got = joined(spark, [(None, a, "en"), (4, near(a), "en"), (5, a, "en"), (None, b, "en"), (6, near(b), "en"), (7, c, "en"), (8, near(c), "en"), (None, d, "en")])
    assert got == [*[(None, t, "en") for t in sorted([a, b, d])], (7, c, "en")]


def test_repeated_ids_lose_no_text(spark):
    rng = random.Random(7)
    a, b = (prose(rng, ENGLISH, 120) for _ in range(2))
    got = joined(spark, [(1, a, "en"), (2, a, "en"), (2, b, "en"), (3, b, "en")])
    assert got == [(1, a, "en"), (2, b, "en")]


def test_of_equal_rows_one_stays(spark):
    rng = random.Random(8)
    a, b = (prose(rng, ENGLISH, 120) for _ in range(2))
    got = joined(spark, [(1, a, "fr"), (1, a, "en"), (1, a, "en"), (2, near(a), "en"), (3, b, "en"), (4, "", "en"), (4, "", "en")])
    assert got == [(1, a, "en"), (3, b, "en"), (4, "", "en"), (4, "", "en")]


def test_run(spark, folder):
    path, rows, _ = folder
    pieces = corpus_pipeline.run(spark, path).collect()
    texts = {r[0]: r[1] for r in rows}
    decode = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    ids = {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        ids.setdefault(p["doc_id"], []).extend(np.frombuffer(bytes(p["ids"]), "<u4").tolist())
    assert set(ids) == set(range(80)) | {90, 105}
    assert ids[1] == decode.encode(texts[1], add_special_tokens=False).ids + [corpus_pipeline.END_ID]


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_cuts_keep_whole_characters():
    text = "aé日b"
    assert suffix_dedup.without_spans(text, [{"start": 2, "end": 5}]) == "aé日b"
    assert suffix_dedup.without_spans(text, [{"start": 1, "end": 5}]) == "a日b"
    assert suffix_dedup.without_spans(text, [{"start": 0, "end": 7}]) == ""
    assert suffix_dedup.without_spans(None, None) is None
