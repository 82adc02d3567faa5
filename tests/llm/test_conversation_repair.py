import hashlib
import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from apisurface.llm import conversation_repair as c

SCHEMA = "conv_id long, turn long, role string, text string, id string, place string, gone boolean"
SOUND = re.compile(r"(s?(ua)+)?")


def every_repair(kinds, most_inserts=2):
    """All edits of a row of kinds that give a sound conversation, by trying them all: the least (cost, audit)."""
    best = None
    gaps = list(product(*[["".join(p) for n in range(most_inserts + 1) for p in product("ua", repeat=n)]] * (len(kinds) + 1)))
    choices = []
    for k in kinds:
        own = [("D", "", 3)]
        if k != "x":
            more = 1 if k.isupper() else 0
            if k.lower() in "sua":
                own.append(("K", k.lower(), more))
            own += [("R", r, 2 + more) for r in "ua"]
        choices.append(own)
    for edits in product(*choices):
        for put in gaps:
            roles, audit, cost = put[0], "I" * len(put[0]), 2 * len(put[0])
            for (letter, role, price), after in zip(edits, put[1:], strict=True):
                roles += role + after
                audit += letter + "I" * len(after)
                cost += price + 2 * len(after)
            if SOUND.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_parse_against_all_edits():
    for n in (0, 1, 2):
        for kinds in product("suaoxSUAO", repeat=n):
            assert c.cheapest("".join(kinds)) == every_repair(kinds), kinds
    rng = random.Random(3)
    for _ in range(25):
        kinds = rng.choices("suaoxSUA", k=3)
        assert c.cheapest("".join(kinds)) == every_repair(kinds, 1), kinds


def left_to_right(kinds):
    """The same least edits by one pass over states; inserts go ahead of a row."""
    after = {"e": "u", "s": "u", "u": "a", "a": "u"}
    best = {"e": (0, "")}
    for k in [*kinds, None]:
        opened = {}
        for state, (cost, audit) in best.items():
            for n in range(3):
                opened[state] = min(opened.get(state, (1 << 60, "")), (cost + 2 * n, audit + "I" * n))
                state = after[state]
        if k is None:
            return min(opened[s] for s in ("e", "a") if s in opened)
        best = {}
        for state, (cost, audit) in opened.items():
            moves = [("D", state, 3)]
            if k != "x":
                more = 1 if k.isupper() else 0
                moves.append(("R", after[state], 2 + more))
                low = k.lower()
                if low in "ua" and after[state] == low or low == "s" and state == "e":
                    moves.append(("K", low, more))
            for letter, to, price in moves:
                best[to] = min(best.get(to, (1 << 60, "")), (cost + price, audit + letter))


@pytest.mark.parametrize("block", [1, 3, 24])
def test_blocks_and_spans_agree_with_one_pass(block):
    rng = random.Random(block)
    for n in (5, 9, 24, 60):
        for _ in range(6):
            kinds = "".join(rng.choices("suaoxSUA", k=n))
            assert c.cheapest(kinds, block) == left_to_right(kinds)


def brute(rows):
    """Plain results of each conversation from (conv, turn, role, text, gone)."""
    out = {}
    for conv in {r[0] for r in rows}:
        told = [(r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows if r[0] == conv and not r[4]]
        digest = lambda r: hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()
        told.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r)))
        kinds, seen, counts = [], set(), [0, 0, 0]
        for _, role, text in told:
            bare = text.strip(" \t\n\x0b\f\r")
            kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if not bare:
                counts[0] += 1
                kind = "x"
            elif (role, text) in seen:
                counts[1] += 1
                kind = "x"
            elif bare[-1] not in ".!?":
                counts[2] += 1
                kind = kind.upper()
            seen.add((role, text))
            kinds.append(kind)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        turns = {t for t, _, _ in told if t is not None}
        cost, audit = left_to_right(kinds)
        lines, wanted, at = [], "u", 0
        for letter in audit:
            role, text = (None, "") if letter == "I" else told[at][1:]
            at += letter != "I"
            if letter == "D":
                continue
            if letter != "K":
                role = {"u": "user", "a": "assistant"}[wanted]
            if role[0] != "s":
                wanted = "a" if role[0] == "u" else "u"
            lines.append((role, text))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, sha)
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r[:4], "x", "y", r[4]) for r in rows], SCHEMA).repartition(3)
    plans, repaired = c.repair(df, "conv_id", "turn", "role", "text", F.col("gone"))
    assert repaired.columns == ["id", "place", "role", "text", "edit"]
    hashes = {r["id"]: r["sha256"] for r in c.digests_in_order(repaired).collect()}
    got = {r["id"]: tuple(r[p] for p in c.PLAN) for r in plans.collect()}
    none = hashlib.sha256(b"").hexdigest()
    expected = brute(rows)
    assert plans.count() == len(expected)
    assert {k: (*v, hashes.get(k, none)) for k, v in got.items()} == expected
    lines = {}
    for r in repaired.collect():
        lines.setdefault(r["id"], []).append((r["place"], r["role"][:1]))
    for told in lines.values():
        assert [p for p, _ in sorted(told)] == list(range(len(told)))
        assert SOUND.fullmatch("".join(r for _, r in sorted(told)))


def conversations(rng, n, most):
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "why", " \n", "", None, "é?", "Yes. \t", "long " * 50 + "."])
            rows.append((conv, rng.choice([turn, turn, turn, None, 3]), role, text, rng.random() < 0.1))
    return rows


def test_against_plain_code(spark):
    rng = random.Random(5)
    check(spark, conversations(rng, 150, 9))


def test_edges(spark):
    long = "word " * 60_000 + "."
    rows = [
        (None, 0, "user", "Hi.", False),
        (None, 1, "assistant", "Hi.", False),
        (1, 0, "user", "Gone.", True),
        (2, None, None, None, False),
        (3, 5, "user", "Same.", False),
        (3, 5, "user", "Same.", False),
        (3, 9, "assistant", long, False),
        (4, 0, "assistant", "x", False),
        (5, -3, "system", "Be kind.", False),
    ]
    check(spark, rows)


def test_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(c, "MANY_ROWS", 40)
    rng = random.Random(6)
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", f"No {i}", f"So {i}!"]), False) for i in range(700)]
    check(spark, rows + conversations(rng, 20, 5))


def test_empty_table(spark):
    plans, repaired = c.repair(spark.createDataFrame([], SCHEMA), "conv_id", "turn", "role", "text")
    assert plans.collect() == [] and repaired.collect() == [] and c.digests_in_order(repaired).collect() == []
