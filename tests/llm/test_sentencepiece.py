import random

import public_tokenizers
import pytest
import sentencepiece

from apisurface.llm.sentencepiece_bpe import PieceModel, encode_decode

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    signs = " ▁  abcdeftheing.,!?\n\t0123éüß日本語한😀"
    out = ["".join(rng.choices(signs, k=rng.randrange(70))) for _ in range(1500)]
    return [*out, "", " ", "a" * 5000, "the" * 2000, " " * 100, "▁" * 33 + "x", "<s></s><unk><0x0A>", "\x00\ufffd\u2047", "...", " .", "a.\n\n.b"]


def test_encoding(library, texts):
    model = PieceModel(PATH, cache_words=40)
    for text in texts:
        ids = library.encode(text) + [2]
        assert model.encode(text) == ids, repr(text)
        assert model.encode_words(text) == (len(ids), " ".join(map(str, ids)), library.decode(ids)), repr(text)


def test_decoding(library):
    model = PieceModel(PATH)
    rng = random.Random(2)
    for _ in range(800):
        ids = rng.choices([*range(3, 300), 2, 1, *range(300, 400)], k=rng.randrange(12))
        assert model.decode(ids) == library.decode(ids), ids
    assert model.decode([0, 5000]) == library.decode([0, 5000])


def test_neighbours(library):
    model = PieceModel(PATH)
    for word in ("▁the", "ing", "tion", "xyzzy"):
        assert model.merged(word) == model.tokens(word)


def test_rows(spark, library):
    rows = [(1, None), (2, ""), (3, "Hello there.\nAnd on."), (3, "Hello there.\nAnd on."), (None, "x"), (4, "long word " * 20000)]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], SCHEMA)
    got = encode_decode(df, "doc_id", "text", PATH).collect()
    expected = []
    for doc, text in rows:
        ids = library.encode(text or "") + [2]
        expected.append((doc, len(ids), " ".join(map(str, ids)), library.decode(ids)))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert encode_decode(spark.createDataFrame([], SCHEMA), "doc_id", "text", PATH).collect() == []
