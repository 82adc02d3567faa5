"""Sorted output, top rows and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apisurface.operators.windows import with_ordinal
from apisurface.ordered import with_global_rank


def ordered(df: DataFrame, kind: str, name: str, within: Sequence[str] = (), kinds: Sequence[str] = ("class", "function")) -> DataFrame:
    """Rows in text order: by group, then kind (classes before functions), then name."""
    rank = F.coalesce(F.nullif(F.array_position(F.lit(list(kinds)), F.col(kind)), F.lit(0)), F.lit(len(kinds) + 1))
    return df.orderBy(*within, rank, name)


def ordered_rank(df: DataFrame, within: Sequence[str], name: str, out: str = "rank") -> DataFrame:
    """1-based place of each row within its group by name."""
    return with_ordinal(df, within, [name], start=1, out=out)


def slowest(df: DataFrame, col: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    """The k largest values, ties broken by the given columns."""
    return df.orderBy(F.col(col).desc(), *ties).limit(k)


def first_n(df: DataFrame, rank: str, n: int) -> DataFrame:
    """The first n rows by a given rank."""
    return df.orderBy(rank).limit(n)


def sample_order(seed: int, ids: Sequence[str]) -> Column:
    """Fixed pseudo-random order of rows under a seed."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


#: Samples of more rows are cut by a threshold in place of a sort.
LARGE_SAMPLE = 10_000
#: First characters of the key that are counted for it.
COUNTED = 4


def sample_k(df: DataFrame, k: int | None, seed: int, id: str, order: Column | None = None) -> DataFrame:
    """k rows without replacement in id order; everything when k is not smaller than the table.

    The same seed gives the same rows. For a small k each task keeps its k first rows only. For a large one, rows are counted by the
    beginning of their key: what begins lower than the k-th row is in the sample without a sort, and only the rows that begin like it
    are put in order. A large sample by an ``order`` of one's own goes by exact places.
    """
    if k is None:
        return df.orderBy(id)
    keyed = df.withColumn("_key", sample_order(seed, [id]) if order is None else order)
    if k <= LARGE_SAMPLE:
        return keyed.orderBy("_key", id).limit(k).drop("_key").orderBy(id)
    if order is not None:
        return with_global_rank(keyed, ["_key", id], "_place").where(F.col("_place") < k).drop("_key", "_place").orderBy(id)
    begin = F.substring("_key", 1, COUNTED)
    # At most 16^4 rows, whatever the table.
    counts = sorted(keyed.groupBy(begin.alias("begin")).count().collect())
    before = 0
    for value, n in counts:
        if before + n > k:
            break
        before += n
    else:
        return df.orderBy(id)
    sure = keyed.where(begin < value)
    rest = keyed.where(begin == value).orderBy("_key", id).limit(k - before)
    return sure.unionByName(rest).drop("_key").orderBy(id)
