import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from apisurface.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, start string"


def test_ids_are_those_of_the_library():
    own, library = packing.WordTokenizer(PATH, 2, cache_words=50), Tokenizer.from_file(PATH)
    rng = random.Random(3)
    signs = "aBcDé.,!?:;' \n\t1２İıΣςß<|>　\xa0\x1c\u0107\u0301"
    texts = ["".join(rng.choices(signs, k=rng.randrange(80))) for _ in range(1500)]
    texts += ["İİ ﬁ <|endoftext|>. a<|startoftext|>b it's. I'LL, don't! 'd", "", "Σας ΟΔΟΣ. क़. naïve, Éa!", "word " * 500]
    for text in texts:
        assert own(text).tolist() == library.encode(text, add_special_tokens=False).ids + [2], repr(text)
    assert own(None).tolist() == [2]


def check_packed(rows, pieces, window, tokens):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(bytes(p["ids"]), "<u4")
        assert len(ids) == p["length"] > 0
        by_doc[p["doc_id"]].append((p["start"], ids, p["doc_tokens"]))
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
    expected = defaultdict(list)
    for doc, text in rows:
        expected[doc].append(tokens(text).tolist())
    for doc, wanted in expected.items():
        got, rest = sorted(by_doc[doc], key=lambda x: x[0]), sorted(map(tuple, wanted))
        if len(wanted) == 1:
            assert [i for _, ids, _ in got for i in ids] == wanted[0]
            assert {n for *_, n in got} == {len(wanted[0])}
        else:
            assert sorted(i for _, ids, _ in got for i in ids) == sorted(i for w in rest for i in w)
    assert set(by_doc) == set(expected)
    return [sum(n for _, n in s) for s in by_sequence.values()]


@pytest.mark.parametrize("parts", [1, 4])
def test_every_id_once(spark, parts):
    rng = random.Random(parts)
    rows = [(i, "word " * rng.choice([0, 1, 3, 20, 63, 64, 65, 200, 1000])) for i in range(300)] + [(None, None), (7, "twice"), (400, "")]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], SCHEMA).repartition(parts)
    tokens = packing.WordTokenizer(PATH, 2)
    fills = check_packed(rows, packing.pack(df, "doc_id", "text", tokens, 64).collect(), 64, tokens)
    assert sum(f < 64 for f in fills) <= parts


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), "doc_id", "text", packing.WordTokenizer(PATH, 2)).collect() == []


def test_level_has_the_least_sum_of_squares():
    rng = random.Random(1)
    packer = packing.Packer(32, 0)
    for i in range(400):
        size = rng.randint(1, 31)
        before = packer.counts.copy()

        def after(level, before=before, size=size):
            n = before.copy()
            if level:
                n[level] -= 1
            if level + size < 32:
                n[level + size] += 1
            return int((n[1:32] ** 2).sum())

        options = [h for h in range(32 - size + 1) if h == 0 or before[h]]
        least = min(map(after, options))
        assert packer.level_for(size) == max(h for h in options if after(h) == least)
        list(packer.place((i, 0, np.zeros(size, np.uint32), size)))


def test_known_words_are_looked_up_once():
    class Known(dict):
        def __contains__(self, word):
            raise AssertionError("looked up twice")

    tokens = packing.WordTokenizer(PATH, 2)
    first = tokens("a  b\n\nc ").tolist()
    tokens.cache = Known(tokens.cache)
    assert tokens(" c\nb").tolist() == [*first[2:0:-1], 2] and tokens(None).tolist() == tokens(" ").tolist() == [2]
