import random

import pytest
from pyspark.sql import functions as F

from apisurface.llm import chat_format

EVENTS = "conv_id long, seq long, turn long, kind string, role string, text string, extra string"
TRICKY = ["\\### Assistant: </turn> ok", "####", "#\\##", "</turn>\n### user: x</turn>", "\\", "\\\\", "<\\/turn>", "<</turn>/turn>", "é日😀", "", "a: b", "#####\\#", "$1 \\$0"]


@pytest.mark.parametrize("role", ["user", "assistant", "a: b", ":", "x:", "", ": ", "#### </turn>"])
def test_round_trip(spark, role):
    rng = random.Random(role)
    texts = TRICKY + ["".join(rng.choices(["#", "\\", "</turn>", "\n", ":", " ", "a", "<", "/"], k=rng.randint(0, 14))) for _ in range(150)]
    rows = [(1, i, role, t) for i, t in enumerate(texts)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.render(messages, learn=(role,)).select(
        "formatted", chat_format.read_back(F.col("formatted")).alias("back"), chat_format.masked_text(F.col("formatted"), F.col("loss_spans")).alias("learned")
    )
    got = out.first()
    assert [(r["role"], r["text"]) for r in got["back"]] == [(role, t) for t in texts]
    assert got["learned"] == "".join(texts)
    assert got["formatted"].count("</turn>") == len(texts) and got["formatted"].count("###") == len(texts)


def folded(events):
    """The same fold, event by event."""
    out = []
    for conv in {e[0] for e in events}:
        turns = {}
        log = sorted((e for e in events if e[0] == conv), key=lambda e: (e[1] is not None, e[1] or 0, e[3] or "message", e[4] is not None, e[4] or "", e[5] or ""))
        for _, seq, turn, kind, role, text in log:
            kind = kind or "message"
            state = turns.setdefault(turn, {"role": None, "text": "", "begun": None})
            state["begun"] = seq if state["begun"] is None else state["begun"]
            if kind in ("message", "edit", "regenerate"):
                state["text"], state["begun"] = text or "", seq
            elif kind == "delta":
                state["text"] += text or ""
            if kind == "regenerate":
                for later in [t for t in turns if t > turn]:
                    del turns[later]
            state["role"] = role if role is not None else state["role"]
        out.extend((conv, t, s["role"] or "", s["text"]) for t, s in turns.items())
    return sorted(out)


def test_fold(spark):
    rng = random.Random(8)
    events = []
    for conv in range(30):
        seq, turns = 0, 0
        for _ in range(rng.randint(1, 25)):
            seq += 1
            kind = rng.choice(["message", "delta", "delta", "edit", "regenerate", "other"]) if turns else "message"
            turn = turns if kind == "message" else rng.randrange(turns)
            turns = turn + 1 if kind in ("message", "regenerate") else turns
            events.append((conv, seq, turn, kind, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb ", None, "#"])))
    rng.shuffle(events)
    df = spark.createDataFrame([(*e, "x") for e in events], EVENTS)
    got = sorted(map(tuple, chat_format.fold_turns(df).collect()))
    assert got == folded(events)


def test_edges(spark):
    empty = spark.createDataFrame([], EVENTS)
    assert chat_format.render(chat_format.fold_turns(empty)).collect() == []
    rows = [(None, None, None, None, None, None, "x"), (1, 1, 0, "message", "user", "q", "x"), (1, 1, 0, "message", "user", "q", "x")]
    got = chat_format.fold_turns(spark.createDataFrame(rows, EVENTS)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, None, "", ""), (1, 0, "user", "q")], key=str)
    long = [(1, i, 0, "delta", "assistant", "x" * 1000, "y") for i in range(1000)]
    assert len(chat_format.fold_turns(spark.createDataFrame(long, EVENTS)).first()["text"]) == 1_000_000
