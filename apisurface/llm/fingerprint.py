"""Document fingerprints: a digest of quartile buckets, close for texts that share most of their bytes.

Six byte triplets of every window of five bytes are hashed to 128 buckets; each bucket is written as the quartile that its
count falls into (two bits), after a head of checksum, logarithm of the length and two quartile ratios. The difference
of two digests adds up bounded parts, so the likeness made from it lies between 0 and 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apisurface.llm.frames import in_arrow, pick
from apisurface.llm.hashing import mix

BUCKETS = 128
#: Places of the second and third byte of each triplet behind the first.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4))
HEAD = 4
#: Difference at which two digests count as unlike altogether.
FARTHEST = 300.0
#: Bytes that are counted at a time, so that memory does not follow the length of a text.
CHUNK = 1 << 20

#: Bucket of each pair of bytes; a triplet's bucket is that of its first pair changed by its last byte.
PAIR = (mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x51)) & np.uint64(0xFF)).astype(np.uint8)
LAST = [(mix(np.arange(256, dtype=np.uint64) + np.uint64(977 * (i + 1))) & np.uint64(BUCKETS - 1)).astype(np.uint8) for i in range(len(TRIPLETS))]
#: Difference of two bytes that hold four quartile codes each: a step counts 1, the way from lowest to highest 6.
CODES = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3
STEP = np.array([0, 1, 2, 6])
BODY = STEP[np.abs(CODES[:, None, :] - CODES[None, :, :])].sum(axis=2).astype(np.int32)


def triplet_counts(data: np.ndarray) -> np.ndarray:
    """Count of each bucket over the triplets of all windows of ``data``; shorter texts are filled up with zero bytes."""
    if len(data) < 5:
        data = np.concatenate([data, np.zeros(5 - len(data), np.uint8)]) if len(data) else data
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(len(data) - 4, 0), CHUNK):
        part = data[at : at + CHUNK + 4]
        n = len(part) - 4
        wide = part.astype(np.uint16)
        for k, (second, third) in enumerate(TRIPLETS):
            pair = (wide[:n] << 8) | wide[second : second + n]
            cell = (PAIR[pair] ^ LAST[k][part[third : third + n]]) & (BUCKETS - 1)
            total += np.bincount(cell, minlength=BUCKETS)
    return total


def digest(data: bytes) -> bytes:
    """Fingerprint of a text's bytes, 36 bytes long. Equal bytes give equal digests; the empty text has one of its own."""
    array = np.frombuffer(data, np.uint8)
    counts = triplet_counts(array)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    body = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    check = int(array.sum(dtype=np.uint64) & np.uint64(0xFF)) if len(array) else 0
    length = min(255, round(8 * math.log(len(data)))) if data else 0
    ratio1, ratio2 = (int(100 * q1 / q3) % 256, int(100 * q2 / q3) % 256) if q3 else (0, 0)
    return bytes((check, length, ratio1, ratio2)) + body.tobytes()


def difference(a: bytes, b: bytes) -> float:
    """Difference of two digests, from 0; each part of the head is bounded."""
    body = BODY[np.frombuffer(a, np.uint8, offset=HEAD), np.frombuffer(b, np.uint8, offset=HEAD)].sum()
    lengths = min(abs(a[1] - b[1]), 24)
    ratios = sum(min(abs(a[i] - b[i]), 12) for i in (2, 3))
    return float(body + lengths + ratios + (a[0] != b[0]))


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal digests, falling with the difference to 0 at ``FARTHEST``."""
    return 1.0 - min(difference(a, b), FARTHEST) / FARTHEST


def with_next(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """Every document in the order of falling ids, dealt to ``_bucket`` by id range.

    The first document of a range is also dealt to the range before it, marked ``_extra``, so that each task finds the text
    that follows its last document without any other; after the last document the first one follows. Only one row of
    ids and bounds for each range is known to the driver.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    shares = [i / parts for i in range(1, parts)]
    bounds = sorted({int(b) for b in rows.approxQuantile("doc_id", shares, 0.2 / parts)}) if shares else []
    if bounds:
        ranks = F.aggregate(
            F.array(*[F.lit(b) for b in bounds]), F.lit(0), lambda n, b: n + F.when(F.col("doc_id") > b, 1).otherwise(0)
        )
    else:
        ranks = F.lit(0)
    # Bucket 0 holds the highest ids; null ids come last of all.
    rank = F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(F.lit(len(bounds)) - ranks).cast("int")
    order = F.struct(F.coalesce(-F.col("doc_id"), F.lit((1 << 63) - 1)).alias("place"), F.xxhash64("text").alias("tie"))
    dealt = rows.withColumns({"_bucket": rank, "_order": order})
    firsts = dealt.groupBy("_bucket").agg(F.min("_order").alias("first")).orderBy("_bucket").collect()
    if not firsts:
        return dealt.withColumn("_extra", F.lit(False))
    first_of = {r["_bucket"]: r["first"] for r in firsts}
    used = sorted(first_of)
    before = {b: used[i - 1] for i, b in enumerate(used)}
    target = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("_bucket")]
    start = F.create_map(
        *[x for b, f in first_of.items() for x in (F.lit(b), F.struct(F.lit(f["place"]).alias("place"), F.lit(f["tie"]).alias("tie")))]
    )[F.col("_bucket")]
    own = F.struct(F.col("_bucket").alias("to"), F.lit(False).alias("extra"))
    extra = F.struct(target.alias("to"), F.lit(True).alias("extra"))
    copies = F.when(F.col("_order") == start, F.array(own, extra)).otherwise(F.array(own))
    spread = dealt.select("doc_id", "text", "_order", F.explode(copies).alias("_copy"))
    return spread.select("doc_id", "text", "_order", F.col("_copy.to").alias("_bucket"), F.col("_copy.extra").alias("_extra"))


def fingerprint_edits(docs: DataFrame, id_col: str, text_col: str, parts: int | None = None) -> DataFrame:
    """``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The edited text of a document has its last third replaced by the start of the next document. Every row
    gives one row; null texts are empty; rows of one id follow each other in the order of a hash of the text, null ids come
    after all others; a single document is its own next. Documents are dealt to ranges of ids, so no task holds more
    than one range, and within it one document and its neighbour at a time.
    """
    import hashlib

    parts = parts or 3 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = with_next(docs, id_col, text_col, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = None

        def judged(doc, following) -> tuple:
            (key, text, data, own), (_, next_text, _, next_own) = doc, following
            n = len(text)
            third = n // 3
            edited = (text[: n - third] + next_text[:third]).encode("utf-8", "surrogatepass")
            other = digest(edited)
            return (key, n, hashlib.sha256(edited).hexdigest(), own.hex(), other.hex(), likeness(own, other), likeness(own, next_own))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.record_batch(columns, NAMES)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for key, text, bucket, is_extra in zip(*columns, strict=True):
                data = text.encode("utf-8", "surrogatepass")
                doc = (key, text, data, digest(data))
                if held is not None and held[0] == bucket:
                    out.append(judged(held[1], doc))
                held = None if is_extra else (bucket, doc)
                if len(out) >= 500:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    spread = dealt.repartition(F.col("_bucket")).sortWithinPartitions("_bucket", "_extra", "_order")
    return in_arrow(spread.select("doc_id", "text", "_bucket", "_extra"), run, SCHEMA)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
