"""Line dedup: overlapping windows of lines that appeared before anywhere are found by hash, what they cover is removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apisurface.functions.types import let
from apisurface.llm.frames import fresh, pick, stored


def window_starts(text: Column, width: int) -> Column:
    """Array of (pos, a, b) of each window of ``width`` lines with a line that is not blank; a and b hash it to 128 bits."""
    hashed = F.transform(
        F.split(text, "\n", -1),
        lambda x: F.struct(
            F.xxhash64(x).alias("a"), F.xxhash64(F.lit("line"), x).alias("b"), (F.trim(x) != "").alias("told")
        ),
    )

    def windows(lines: Column) -> Column:
        last = F.size(lines) - width
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

        def entry(i: Column) -> Column:
            cut = [F.get(lines, i + k) for k in range(width)]
            told = cut[0]["told"]
            for x in cut[1:]:
                told = told | x["told"]
            return F.struct(
                i.alias("pos"), F.xxhash64(*[x["a"] for x in cut]).alias("a"), F.xxhash64(*[x["b"] for x in cut]).alias("b"), told.alias("told")
            )

        return F.filter(F.transform(places, entry), lambda w: w["told"])

    # Lines are cut and hashed once for each text, not once for each window.
    return let(hashed, windows)


def covered_lines(docs: DataFrame, id_col: str, text_col: str, width: int = 3) -> DataFrame:
    """``_id``, ``_tie`` (hash of the text) and ``starts``, the first lines of the windows that appeared before.

    A window appeared before if one of the same lines starts in a document of smaller id, or earlier in the same
    one. Copies of windows are counted where they lie before they are shuffled; no window's copies are gathered.
    """
    rows = pick(docs, _id=id_col, _text=text_col).select("_id", F.xxhash64("_text").alias("_tie"), "_text")
    windows = rows.select("_id", "_tie", F.explode(window_starts(F.col("_text"), width)).alias("w"))
    windows = stored(windows.select(F.struct("_id", "_tie", "w.pos").alias("at"), "w.a", "w.b"), "windows")
    firsts = windows.groupBy("a", "b").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    later = windows.join(firsts.where(F.col("n") > 1).drop("n"), ["a", "b"]).where(F.col("at") > F.col("first"))
    return later.groupBy("at._id", "at._tie").agg(F.collect_set("at.pos").alias("starts"))


def remove_repeated_lines(docs: DataFrame, id_col: str, text_col: str, width: int = 3) -> DataFrame:
    """``docs`` with repeated windows of lines taken out of the text, and ``n_lines``, ``n_removed_lines``.

    One row for each row, other columns as they were (columns of those two names are replaced). A line goes if any window of ``width``
    lines that covers it appeared before; windows are judged on the input. Windows of blank lines alone do not
    count; texts of fewer lines stay as they are, null texts too (with no lines). Rows with the same id and text are one
    document and treated alike; rows of one id with other texts are told apart by a hash of the text, in its order. Null ids come first.
    """
    source = docs.drop("n_lines", "n_removed_lines")
    id_name, tie_name, starts_name = (fresh(n, source.columns) for n in ("_id_key", "_tie_key", "_starts"))
    covered = covered_lines(source, id_col, text_col, width)
    covered = covered.select(F.col("_id").alias(id_name), F.col("_tie").alias(tie_name), F.col("starts").alias(starts_name))
    text = F.col(f"`{text_col}`")
    same = source[f"`{id_col}`"].eqNullSafe(covered[id_name]) & (F.xxhash64(source[f"`{text_col}`"]) == covered[tie_name])
    joined = source.join(covered, same, "left")
    lines = F.split(text, "\n", -1)
    gone = F.array_distinct(F.flatten(F.transform(starts_name, lambda s: F.sequence(s, s + (width - 1)))))

    def remaining(parts: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
        return F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")

    rest = let(lines, remaining)
    touched = F.col(starts_name).isNotNull()
    return joined.select(
        *[
            F.when(touched, rest).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`")
            for c in source.columns
        ],
        F.when(text.isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
        F.when(touched, F.size(gone)).otherwise(0).alias("n_removed_lines"),
    )
