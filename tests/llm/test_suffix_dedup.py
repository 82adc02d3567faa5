import random

import numpy as np
import pytest

from apisurface.llm import suffix_dedup
from apisurface.llm.hashing import prefix_hashes

SCHEMA = "doc_id long, text string, spans string"


def brute(rows, width):
    """Covered bytes of each (id, text), by a table of every string of the given width."""
    seen = {}
    keyed = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    result = {}
    for doc, text in keyed:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - width + 1):
            piece = data[s : s + width]
            if piece in seen:
                gone[s : s + width] = True
            else:
                seen[piece] = (doc, s)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        result[doc, text] = (len(data), [tuple(map(int, e)) for e in edges.reshape(-1, 2)], kept)
    return result


def check(spark, rows, width):
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], SCHEMA).repartition(3)
    got = suffix_dedup.find_repeats(df, "doc_id", "text", width).collect()
    assert len(got) == len(rows)
    expected = brute(rows, width)
    shown = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in got)
    wanted = sorted((d is not None, d or 0, *expected[d, t]) for d, t in rows)
    assert shown == wanted


def test_against_every_string(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    passages = [" ".join(rng.choices(words, k=rng.randint(8, 60))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            cut = sorted(rng.sample(range(len(p)), 2))
            parts.append(rng.choice([p, p[cut[0] : cut[1]], " ".join(rng.choices(words, k=8))]))
        rows.append((i, " ".join(parts)))
    for i in range(150, 190):
        copied = list(rows[rng.randrange(60)][1] or "x")
        for _ in range(rng.randint(0, 4)):
            copied[rng.randrange(len(copied))] = rng.choice("xyz")
        rows.append((i, "".join(copied)))
    check(spark, rows, 100)
    check(spark, rows, 40)


def test_edges(spark):
    text = "the quick brown fox jumps over the lazy dog " * 9
    rows = [(1, None), (2, ""), (3, text), (3, text), (None, text[:120]), (5, "a" * 700), (6, "ab" * 300), (7, "x" + text), (8, "a" * 99), (9, "a" * 100)]
    check(spark, rows, 100)
    check(spark, [(4, "short")], 100)


def test_equal_rows_of_unique_text_keep_it(spark):
    rng = random.Random(8)

    def unique():
        return "".join(rng.choices("abcdefghijklmnop ", k=300))

    phrases = [unique()[:90] for _ in range(4)]
    rows = []
    for i, phrase in enumerate(phrases):
        text = unique() + phrase + unique()
        rows += [(10 + i, text), (10 + i, text), (20 + i, unique() + phrase + unique())]
    rows += [(None, rows[0][1][:200] + unique())] * 2
    check(spark, rows, 100)
    df = spark.createDataFrame([(a, b, "x") for a, b in rows if a is not None], SCHEMA)
    out = suffix_dedup.remove_repeats(df, "doc_id", "text").collect()
    assert not any(r["repeated"] for r in out) and sorted((r["doc_id"], r["text"]) for r in out) == sorted(r for r in rows if r[0] is not None)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.find_repeats(df, "doc_id", "text").collect() == []


def test_width_is_bounded(spark):
    with pytest.raises(ValueError):
        suffix_dedup.find_repeats(spark.createDataFrame([], SCHEMA), "doc_id", "text", 20)


def test_long_text_over_chunks(monkeypatch):
    rng = random.Random(1)
    data = np.frombuffer(bytes(rng.choices(b"abcdefgh ", k=5000)), np.uint8)
    whole = suffix_dedup.anchors(data, 100)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 333)
    cut = suffix_dedup.anchors(data, 100)
    assert all((x == y).all() for x, y in zip(whole, cut, strict=True))


def test_sorted_suffixes():
    rng = random.Random(2)
    data = np.frombuffer(bytes(rng.choices(b"ab", k=900)), np.uint8)
    prefix = prefix_hashes(data)
    at = np.arange(860)
    bucket = np.array(rng.choices(range(3), k=860))
    order, equal = suffix_dedup.sort_suffixes(data, prefix, at, bucket, 12)
    keys = [(bucket[i], bytes(data[at[i] : at[i] + 12])) for i in range(860)]
    assert [keys[i] for i in order] == sorted(keys)
    assert list(order) == sorted(range(860), key=lambda i: (keys[i], i))
    assert all(equal[k] == (keys[order[k]] == keys[order[k - 1]]) for k in range(1, 860))


def unique_text(rng, n=300):
    return "".join(rng.choices("abcdefghijklmnop ", k=n))


@pytest.mark.parametrize("doc", [None, 7])
def test_many_texts_of_one_id_share_no_spans(spark, doc):
    rng = random.Random(11)
    passage = unique_text(rng, 150)
    rows = [(doc, unique_text(rng, rng.choice([90, 300])) + (passage if i % 2 else "")) for i in range(1200)]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], SCHEMA).repartition(4)
    for r in suffix_dedup.find_repeats(df, "doc_id", "text").collect():
        # The passage, and at most the few letters before it that agree by chance.
        assert all(150 <= x["end"] - x["start"] < 160 for x in r["spans"])
    found = suffix_dedup.find_repeats(df, "doc_id", "text").where("size(spans) > 0").count()
    assert found == 599
    out = [r for r in suffix_dedup.remove_repeats(df, "doc_id", "text").collect()]
    assert sum(r["repeated"] for r in out) == 599
    whole = {t for _, t in rows if not t.endswith(passage)}
    assert whole <= {r["text"] for r in out if not r["repeated"]}


def test_very_long_text(spark):
    rng = random.Random(12)
    text = unique_text(rng, 1_300_000)
    rows = [(1, text), (2, "x" + text[600_000:700_000] + "y")]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], SCHEMA)
    got = {r["doc_id"]: r for r in suffix_dedup.find_repeats(df, "doc_id", "text").collect()}
    assert got[1]["spans"] == [] and bytes(got[2]["kept"]) == b"xy"
