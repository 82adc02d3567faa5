import random

from apisurface.llm.line_dedup import remove_repeated_lines

SCHEMA = "doc_id long, text string, starts string"


def brute(rows, width=3):
    seen, out = set(), []
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        if text is None:
            out.append((doc, None, 0, 0))
            continue
        lines, gone = text.split("\n"), set()
        for i in range(len(lines) - width + 1):
            window = tuple(lines[i : i + width])
            if not any(x.strip(" ") for x in window):
                continue
            if window in seen:
                gone.update(range(i, i + width))
            seen.add(window)
        kept = [x for i, x in enumerate(lines) if i not in gone]
        out.append((doc, "\n".join(kept), len(lines), len(gone)))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], SCHEMA).repartition(3)
    out = remove_repeated_lines(df, "doc_id", "text")
    assert out.columns == ["doc_id", "text", "starts", "n_lines", "n_removed_lines"]
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed_lines"]) for r in out.collect()), key=str)


def test_against_plain_code(spark):
    rng = random.Random(6)
    lines = ["one", "two", "", "three ", "four"]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(1, 9)))) for i in range(60)]
    rows += [(60 + i, "\n".join(f"line {rng.randrange(40)}" for _ in range(12))) for i in range(60)]
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a\nb"), (4, "a\nb"), (5, "\n\n\n\n"), (6, "\n\n\n\n"), (None, "p\nq\nr"), (7, "p\nq\nr\ns"), (8, "a\nb\nc\n" * 2000)]
    assert run(spark, rows) == sorted(brute(rows), key=str)
    assert run(spark, []) == []


def test_repeated_rows_are_one_document(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")]
    assert run(spark, rows) == [(1, "a\nb\nc", 3, 0), (1, "a\nb\nc", 3, 0), (2, "", 3, 3)]
