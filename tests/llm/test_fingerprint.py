import hashlib
import random

import numpy as np
import pytest

from apisurface.llm import fingerprint

SCHEMA = "doc_id long, text string, n_chars string"


def plain_counts(data):
    if 0 < len(data) < 5:
        data = data + bytes(5 - len(data))
    out = [0] * fingerprint.BUCKETS
    for i in range(len(data) - 4):
        for k, (b, c) in enumerate(fingerprint.TRIPLETS):
            pair = data[i] << 8 | data[i + b]
            out[(int(fingerprint.PAIR[pair]) ^ int(fingerprint.LAST[k][data[i + c]])) % fingerprint.BUCKETS] += 1
    return out


def test_counts(monkeypatch):
    data = bytes(random.Random(1).choices(b"abcdefgh \n", k=700))
    assert fingerprint.triplet_counts(np.frombuffer(data, np.uint8)).tolist() == plain_counts(data)
    monkeypatch.setattr(fingerprint, "CHUNK", 97)
    assert fingerprint.triplet_counts(np.frombuffer(data, np.uint8)).tolist() == plain_counts(data)
    for short in (b"", b"a", b"abcd", b"abcde"):
        assert fingerprint.triplet_counts(np.frombuffer(short, np.uint8)).tolist() == plain_counts(short)


def test_likeness_is_bounded_and_orders_texts():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
    base = " ".join(rng.choices(words, k=300))
    near = base.replace(words[0], words[1])[: len(base) - 20]
    far = " ".join("".join(rng.choices("klmnopqr", k=5)) for _ in range(300))
    a, b, c = (fingerprint.digest(t.encode()) for t in (base, near, far))
    assert fingerprint.likeness(a, a) == 1.0
    assert 1 > fingerprint.likeness(a, b) > fingerprint.likeness(a, c) >= 0
    assert fingerprint.likeness(a, b) == fingerprint.likeness(b, a)


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (doc, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        text, following = text or "", following or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        own, other, nxt = (fingerprint.digest(t.encode()) for t in (text, edited, following))
        sha = hashlib.sha256(edited.encode()).hexdigest()
        out.append((doc, len(text), sha, own.hex(), other.hex(), fingerprint.likeness(own, other), fingerprint.likeness(own, nxt)))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_against_a_sorted_list(spark, parts):
    rng = random.Random(parts)
    rows = [(i * 3, "".join(rng.choices("abcé😀 \n", k=rng.choice([0, 1, 2, 3, 50, 400])))) for i in range(80)]
    rows += [(None, "no id"), (500, None)]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], SCHEMA).repartition(4)
    got = fingerprint.fingerprint_edits(df, "doc_id", "text", parts).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_edges(spark):
    assert fingerprint.fingerprint_edits(spark.createDataFrame([], SCHEMA), "doc_id", "text").collect() == []
    single = fingerprint.fingerprint_edits(spark.createDataFrame([(1, "abcdef", "x")], SCHEMA), "doc_id", "text").collect()
    assert sorted(map(tuple, single)) == brute([(1, "abcdef")])
    twice = spark.createDataFrame([(1, "abcdef", "x"), (1, "abcdef", "x"), (2, "q", "x")], SCHEMA)
    assert fingerprint.fingerprint_edits(twice, "doc_id", "text").count() == 3
