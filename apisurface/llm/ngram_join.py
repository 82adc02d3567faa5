"""N-gram Jaccard join by prefixes of the global n-gram order.

The order puts rare n-grams first (frequent ones are known from a bounded table), the rest by hash. Two sets of the wanted
similarity share an n-gram among the first few of both, so candidates meet in the buckets of these; sizes, places and
bitmaps of the sets rule out most of them. Overlaps are counted by vertical partitioning: the global order is cut into fragments,
each set is dealt to rows of one fragment each, fragments of the two sets of a candidate pair meet by document and
fragment, and their counts are summed for the pair. Equal sets count as one from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apisurface.llm.components import connected_components
from apisurface.llm.frames import in_arrow, pick, sliced, stored
from apisurface.llm.hashing import U64, mix
from apisurface.llm.shingles import shingle_hashes

#: Most entries of the table of frequent n-grams, which orders them; others are ordered by hash alone.
FREQUENT = 200_000
#: Least count that makes an n-gram frequent.
FREQUENT_FROM = 8
#: Words of 64 bits in the bitmap of a set that goes through the buckets.
BITMAP = 8
#: Most words of the wide bitmap that long sets have as well: at least two bits for each member.
WIDE = 1 << 10
#: Buckets of more sets are joined to the best of a few probes, others to their first set.
LARGE_BUCKET = 64
PROBES = 16
#: Pairs that are tested at a time.
TILE = 1 << 20
#: Cuts of the global order: equal ranges of the hashes of n-grams not known as frequent, and the frequent ones behind them.
FRAGMENTS = 4
#: Sets that a task remembers in order not to give them out again: 8 MB whatever the data.
REMEMBERED_SETS = 1 << 20
#: 64-bit words of the filter of wanted documents: 8 MB whatever the data; beyond it lets more through, which a join removes.
FILTER_WORDS = 1 << 20


def bitmap_of(hashes: np.ndarray, words: int = BITMAP) -> np.ndarray:
    """Parity of the number of members at each bit: sets that differ in d members differ in at most d bits."""
    flips = np.bincount((mix(hashes) & U64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(U64)


def wide_bitmap_of(hashes: np.ndarray) -> np.ndarray | None:
    """Bitmap of a set that is too large for the usual one, of a power of two of words; others have none."""
    words = BITMAP
    while 64 * words < 2 * len(hashes) and words < WIDE:
        words *= 2
    return bitmap_of(hashes, words) if words > BITMAP else None


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of fewer words of the same set: parities of the parts that fall together."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, words), axis=0)


def signature(hashes: np.ndarray) -> int:
    """64 bits that stand for a set, together with its size."""
    total = mix(hashes + np.arange(1, len(hashes) + 1, dtype=U64)).sum(keepdims=True, dtype=U64)
    return int(mix(total).view(np.int64)[0])


def profiles(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """A row for each document (its set's signature, size, bitmaps), and counts of n-grams that come twice in a task."""
    held: list[np.ndarray] = []
    size = 0
    fields = ["doc", "sig", "n", "bitmap", "wide", "gram", "times"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())

    def counted() -> Iterator[pa.RecordBatch]:
        grams, times = np.unique(np.concatenate(held), return_counts=True)
        often = times > 1
        none = [pa.nulls(int(often.sum()), k) for k in kinds[:5]]
        yield pa.record_batch([*none, pa.array(grams[often].view(np.int64)), pa.array(times[often])], fields)

    for batch in sliced(batches):
        docs, sigs, sizes, maps, wides = [], [], [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            hashes = shingle_hashes(text or b"", words)
            docs.append(doc)
            sigs.append(signature(hashes))
            sizes.append(len(hashes))
            maps.append(bitmap_of(hashes).tobytes())
            wide = wide_bitmap_of(hashes)
            wides.append(None if wide is None else wide.tobytes())
            held.append(hashes)
            size += len(hashes)
        columns = [pa.array(x, k) for x, k in zip((docs, sigs, sizes, maps, wides), kinds, strict=False)]
        yield pa.record_batch([*columns, *[pa.nulls(len(docs), k) for k in kinds[5:]]], fields)
        if size > 1_000_000:
            yield from counted()
            held, size = [], 0
    if held:
        yield from counted()


def ordered(hashes: np.ndarray, grams: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Members of a set in the global order: those not known as frequent by hash, then the frequent ones by rank."""
    if not len(grams):
        return hashes
    at = np.minimum(np.searchsorted(grams, hashes), len(grams) - 1)
    rank = np.where(grams[at] == hashes, ranks[at], -1)
    return hashes[np.lexsort((hashes, rank))]


def prefix_size(n: int, similarity: tuple[int, int]) -> int:
    """How many of the first members are enough: n less the smallest overlap, and one."""
    part, whole = similarity
    return n - -(-part * n // whole) + 1


def prefixes(batches: Iterator[pa.RecordBatch], words: int, similarity: tuple[int, int], frequent) -> Iterator[pa.RecordBatch]:
    """(gram, sig, n, place) of the first members of each set; sets that a task has met already are left out."""
    grams, ranks = frequent.value
    met = np.zeros(REMEMBERED_SETS, np.int64)
    for batch in sliced(batches):
        out = []
        for text in batch.column(0).to_pylist():
            hashes = shingle_hashes(text or b"", words)
            n = len(hashes)
            key = signature(hashes)
            slot = key & (REMEMBERED_SETS - 1)
            if not n or met[slot] == key:
                continue
            met[slot] = key
            first = ordered(hashes, grams, ranks)[: prefix_size(n, similarity)]
            out.append((first.view(np.int64), key, n))
        sizes = [len(x[0]) for x in out]
        columns = [
            np.concatenate([x[0] for x in out]) if out else np.zeros(0, np.int64),
            np.repeat(np.array([x[1] for x in out], np.int64), sizes),
            np.repeat(np.array([x[2] for x in out], np.int64), sizes),
            np.concatenate([np.arange(s) for s in sizes]) if out else np.zeros(0, np.int64),
        ]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["gram", "sig", "n", "place"])


def possible(n1, p1, m1, n2, p2, m2, similarity: tuple[int, int]) -> np.ndarray:
    """Whether pairs can reach the similarity by sizes, places of the shared member and bitmaps; arrays of equal shape."""
    part, whole = similarity
    small, large = np.minimum(n1, n2), np.maximum(n1, n2)
    fits = whole * small >= part * large
    # overlap >= part / (part + whole) * (n1 + n2)
    need = -(-part * (n1 + n2) // (part + whole))
    fits &= np.minimum(n1 - p1, n2 - p2) + np.minimum(p1, p2) >= need
    at = np.flatnonzero(fits)
    differ = np.bitwise_count(m1[at] ^ m2[at]).sum(axis=1)
    fits[at] = differ <= n1[at] + n2[at] - 2 * need[at]
    return fits


def bucket_pairs(batches: Iterator[pa.RecordBatch], similarity: tuple[int, int], by_component: bool) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of buckets; rows are sorted by gram.

    At first those of one set of each bucket with all others. Later (``by_component``) all pairs of sets that lie in
    different components by then.
    """
    from apisurface.llm.suffix_dedup import groups_of

    for columns in groups_of(batches, 6, 20_000):
        gram, sig, n, place, comp = (columns[i].to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3, 5))
        maps = np.frombuffer(b"".join(columns[4].to_pylist()), U64).reshape(-1, BITMAP)
        starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(gram)]]))
        found = [np.zeros((0, 4), np.int64)]

        def test(x: np.ndarray, y: np.ndarray, maps=maps, n=n, place=place, sig=sig, found=found) -> np.ndarray:
            fits = possible(n[x], place[x], maps[x], n[y], place[y], maps[y], similarity)
            if fits.any():
                x, y = x[fits], y[fits]
                swap = sig[x] > sig[y]
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                found.append(np.stack([sig[x], n[x], sig[y], n[y]], axis=1))
            return fits

        for size in np.unique(sizes):
            first = starts[sizes == size]
            if size <= LARGE_BUCKET:
                i, j = np.triu_indices(size, 1) if by_component else (np.zeros(size - 1, np.int64), np.arange(1, size))
                step = max(1, TILE // max(len(i), 1))
                for at in range(0, len(first), step):
                    part = first[at : at + step, None]
                    x, y = (part + i).ravel(), (part + j).ravel()
                    apart = comp[x] != comp[y] if by_component else slice(None)
                    test(x[apart], y[apart])
                continue
            for begin in first:
                members = np.arange(begin, begin + size)
                if not by_component:
                    probes = members[:: max(1, size // PROBES)][:PROBES]
                    best = max(probes, key=lambda p: (test_only(p, members, n, place, maps, similarity), -p))
                    others = members[members != best]
                    test(np.full(len(others), best), others)
                    continue
                # Members of all components but the largest meet those of every other component.
                names, index, counts = np.unique(comp[members], return_inverse=True, return_counts=True)
                rest = members[index != counts.argmax()]
                if not len(rest):
                    continue
                step = max(1, TILE // size)
                order = np.full(len(gram), -1, np.int64)
                order[rest] = np.arange(len(rest))
                for at in range(0, len(rest), step):
                    x, y = np.repeat(rest[at : at + step], size), np.tile(members, len(rest[at : at + step]))
                    apart = (comp[x] != comp[y]) & ((order[y] < 0) | (order[x] < order[y]))
                    test(x[apart], y[apart])
        pairs = np.unique(np.concatenate(found), axis=0)
        yield pa.record_batch([pa.array(pairs[:, i]) for i in range(4)], ["s1", "n1", "s2", "n2"])


def test_only(probe: int, members: np.ndarray, n, place, maps, similarity) -> int:
    x = np.full(len(members), probe)
    return int(possible(n[x], place[x], maps[x], n[members], place[members], maps[members], similarity).sum())


def near_enough(batches: Iterator[pa.RecordBatch], similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Pairs that their wide bitmaps do not rule out; pairs without are passed on."""
    part, whole = similarity
    for batch in batches:
        n1, n2 = batch.column(1).to_numpy(), batch.column(4).to_numpy()
        most = n1 + n2 - 2 * -(-part * (n1 + n2) // (part + whole))
        kept = []
        for w1, w2, limit in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), most, strict=True):
            if w1 is None or w2 is None:
                kept.append(True)
                continue
            a, b = np.frombuffer(w1, U64), np.frombuffer(w2, U64)
            words = min(len(a), len(b))
            kept.append(bool(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum() <= limit))
        yield pa.record_batch(batch.columns[:6], batch.schema.names[:6]).filter(pa.array(kept, pa.bool_()))


PAIRS = ["s1", "n1", "d1", "s2", "n2", "d2"]


def verified(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs that reach the similarity: overlaps are counted by pair and fragment, and summed for the pair.

    Rows of ``sets`` may be repeated; a pair counts once in each fragment.
    """
    part, whole = similarity
    one, two = (
        sets.select("fragment", *[F.col(c).alias(f"{name}{k}") for c, name in (("doc", "d"), ("sig", "s"), ("n", "n"), ("grams", "g"))])
        for k in (1, 2)
    )
    dealt = pairs.withColumn("fragment", F.explode(F.array(*[F.lit(i) for i in range(FRAGMENTS)])))
    joined = dealt.join(one, ["d1", "s1", "n1", "fragment"]).join(two, ["d2", "s2", "n2", "fragment"])
    partial = joined.select(*PAIRS, "fragment", F.size(F.array_intersect("g1", "g2")).cast("bigint").alias("partial"))
    partial = partial.groupBy(*PAIRS, "fragment").agg(F.max("partial").alias("partial"))
    total = partial.groupBy(*PAIRS).agg(F.sum("partial").alias("shared"))
    return total.where(F.col("shared") * whole >= (F.col("n1") + F.col("n2") - F.col("shared")) * part)


def filter_words(docs: DataFrame) -> np.ndarray:
    """Bit set of document ids, combined where they lie; false positives are possible."""
    h = F.xxhash64("doc")
    word = F.shiftrightunsigned(h, 6).bitwiseAND(FILTER_WORDS - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(63).cast("int"))
    words = docs.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(FILTER_WORDS, U64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(U64)
    return out


def fragment_of(hashes: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The fragment of the global order each n-gram lies in; ``grams`` are the frequent ones, which come last."""
    ranges = U64(FRAGMENTS - 1)
    fragment = ((hashes >> U64(32)) * ranges >> U64(32)).astype(np.int64)
    if len(grams):
        at = np.minimum(np.searchsorted(grams, hashes), len(grams) - 1)
        fragment[grams[at] == hashes] = FRAGMENTS - 1
    return fragment


def cut_fragments(batches: Iterator[pa.RecordBatch], words: int, wanted, frequent) -> Iterator[pa.RecordBatch]:
    """Sets of the documents that may be wanted (doc, its hash, text), a row for each fragment they have members of."""
    filter_, (grams, _) = wanted.value, frequent.value
    one = U64(1)
    for batch in sliced(batches):
        h = batch.column(1).to_numpy().view(U64)
        passed = np.flatnonzero(filter_[(h >> U64(6)) & U64(FILTER_WORDS - 1)] >> (h & U64(63)) & one)
        docs, texts = batch.column(0).to_pylist(), batch.column(2)
        for at in range(0, len(passed), 200):
            rows, parts = [], []
            for i in passed[at : at + 200]:
                members = shingle_hashes(texts[int(i)].as_py() or b"", words)
                fragment = fragment_of(members, grams)
                sig = signature(members)
                for f in np.unique(fragment):
                    rows.append((docs[i], sig, len(members), int(f)))
                    parts.append(members[fragment == f].view(np.int64))
            if not rows:
                continue
            ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.record_batch([*columns, lists], ["doc", "sig", "n", "fragment", "grams"])


def near_classes(docs: DataFrame, id_col: str, text_col: str, words: int = 4, similarity: tuple[int, int] = (85, 100)) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``: the smallest id reachable by links between similar documents.

    The set of a text holds its distinct stretches of ``words`` words (A-Z lower-cased, cut at blanks and the bytes 9 to 13); a shorter text
    is one stretch as a whole. Texts without words, or null, have no set and are linked with nothing. Two documents are linked if the
    intersection of their sets is at least ``similarity`` of the union. One row for each row; rows of one id are one node of
    all their texts; null ids count as the smallest and stay null. No pair of equal sets is ever made; all links between
    different sets are found or follow from others.
    """
    spark = docs.sparkSession
    texts = pick(docs, _id=id_col, _text=text_col).select(F.coalesce(F.col("_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), F.col("_text").cast("binary").alias("text"))
    profile = stored(
        in_arrow(texts, lambda b: profiles(b, words), "doc long, sig long, n long, bitmap binary, wide binary, gram long, times long"), "profiles"
    )
    counts = profile.where(F.col("gram").isNotNull()).groupBy("gram").agg(F.sum("times").alias("times"))
    top = counts.where(F.col("times") >= FREQUENT_FROM).orderBy(F.desc("times"), "gram").limit(FREQUENT).toPandas()
    grams = top["gram"].to_numpy(np.int64).view(U64)
    by_gram = np.argsort(grams)
    frequent = spark.sparkContext.broadcast((grams[by_gram], len(grams) - by_gram.astype(np.int64)))
    sets = profile.where(F.col("doc").isNotNull() & (F.col("n") > 0))
    classes = sets.groupBy("sig", "n").agg(F.min("doc").alias("first"), F.first("bitmap").alias("bitmap"))
    classes = stored(classes, "classes")

    entries = in_arrow(
        texts.select("text"), lambda b: prefixes(b, words, similarity, frequent), "gram long, sig long, n long, place long"
    )
    dealt = entries.repartition("gram").sortWithinPartitions("gram", "sig", "n")
    repeated = stored(in_arrow(dealt, keep_repeated, BUCKETS), "buckets")
    # Of buckets that hold the same sets one is enough.
    heads = repeated.where("head").groupBy("members", "size").agg(F.min("gram").alias("gram"))
    buckets = repeated.join(heads.select("gram"), "gram", "left_semi")
    buckets = stored(buckets.join(classes.select("sig", "n", "first"), ["sig", "n"]).drop("members", "head"), "buckets")

    def candidates(rows: DataFrame, by_component: bool) -> DataFrame:
        """``rows`` are buckets with ``comp``."""
        slim = rows.select("gram", "sig", "n", "place", "comp").join(classes.select("sig", "n", "bitmap"), ["sig", "n"])
        slim = slim.select("gram", "sig", "n", "place", "bitmap", "comp").repartition("gram").sortWithinPartitions("gram", "sig")
        pairs = in_arrow(slim, lambda b: bucket_pairs(b, similarity, by_component), "s1 long, n1 long, s2 long, n2 long").distinct()
        for k in (1, 2):
            name = classes.select(F.col("sig").alias(f"s{k}"), F.col("n").alias(f"n{k}"), F.col("first").alias(f"d{k}"))
            pairs = pairs.join(name, [f"s{k}", f"n{k}"])
        pairs = stored(pairs.select(*PAIRS), "pairs")
        for k in (1, 2):
            wide = profile.where(F.col("wide").isNotNull()).select(F.col("doc").alias(f"d{k}"), F.col("sig").alias(f"s{k}"), F.col("wide").alias(f"w{k}"))
            pairs = pairs.join(wide, [f"d{k}", f"s{k}"], "left")
        schema = "s1 long, n1 long, d1 long, s2 long, n2 long, d2 long"
        return stored(in_arrow(pairs.select(*PAIRS, "w1", "w2"), lambda b: near_enough(b, similarity), schema).distinct(), "near")

    def links_of(pairs: DataFrame) -> DataFrame:
        needed = pairs.select(F.col("d1").alias("doc")).unionByName(pairs.select(F.col("d2").alias("doc")))
        wanted = spark.sparkContext.broadcast(filter_words(needed))
        # The filter lets some others through, and rows that share an id may hold other sets: they find no pair.
        cut = in_arrow(
            texts.select("doc", F.xxhash64("doc").alias("h"), "text"),
            lambda b: cut_fragments(b, words, wanted, frequent),
            "doc long, sig long, n long, fragment int, grams array<long>",
        )
        return verified(pairs, cut, similarity).select(F.col("d1").alias("x"), F.col("d2").alias("y"))

    # Rows of one id with several sets belong to several classes, whose first documents may differ.
    shared = sets.join(classes, ["sig", "n"]).where(F.col("doc") != F.col("first")).select(F.col("doc").alias("x"), F.col("first").alias("y"))
    links = stored(links_of(candidates(buckets.withColumn("comp", F.lit(0).cast("bigint")), False)), "links")
    labels = connected_components(links)
    known = buckets.where(F.col("size") > 2).join(labels.select(F.col("node").alias("first"), "component"), "first", "left")
    known = known.withColumn("comp", F.coalesce("component", "first")).select("gram", "sig", "n", "place", "comp")
    mixed = known.groupBy("gram").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    rest = stored(known.join(mixed.select("gram"), "gram", "left_semi"), "buckets")
    if not rest.isEmpty():
        links = stored(links.unionByName(links_of(candidates(rest, True))), "links")
    repeated_ids = sets.groupBy("doc").agg(F.count_distinct("sig", "n").alias("sets")).where(F.col("sets") > 1)
    ties = shared.join(repeated_ids.select(F.col("doc").alias("x")), "x", "left_semi")
    labels = connected_components(links.unionByName(ties))
    found = labels.select(F.col("node").alias("first"), "component")
    keyed = profile.where(F.col("doc").isNotNull()).select("doc", "sig", "n")
    # The label of a class is that of its first document; a class without links is its own component.
    of_class = classes.select("sig", "n", "first").join(found, "first", "left")
    of_class = of_class.select("sig", "n", F.coalesce("component", "first").alias("component"))
    out = keyed.join(of_class, ["sig", "n"], "left").select("doc", "n", F.coalesce("component", "doc").alias("component"))
    return out.select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("component") != NO_ID, F.col("component")).alias("component_id"),
    )


NO_ID = -(1 << 63)
BUCKETS = "gram long, sig long, n long, place long, size long, members long, head boolean"


def keep_repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by gram, signature and size: each set once, of grams that several sets hold, with number and hash of these."""
    from apisurface.llm.suffix_dedup import groups_of

    for columns in groups_of(batches, 4, 200_000):
        gram, sig, n, place = (c.to_numpy() for c in columns)
        new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
        new_set = new_gram | np.concatenate([[True], (sig[1:] != sig[:-1]) | (n[1:] != n[:-1])])
        gram, sig, n, place = gram[new_set], sig[new_set], n[new_set], place[new_set]
        head = new_gram[new_set]
        starts = np.flatnonzero(head)
        sizes = np.diff(np.concatenate([starts, [len(gram)]]))
        size = np.repeat(sizes, sizes)
        whole = np.add.reduceat(mix(mix(sig.view(U64)) + n.astype(U64)), starts) if len(starts) else np.zeros(0, U64)
        members = np.repeat(whole.view(np.int64), sizes)
        kept = size > 1
        columns = [pa.array(x[kept]) for x in (gram, sig, n, place, size, members, head)]
        yield pa.record_batch(columns, ["gram", "sig", "n", "place", "size", "members", "head"])
