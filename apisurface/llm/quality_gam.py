"""Quality of texts by a generalised additive model with pairwise interactions.

Each text becomes a row of shape figures (``FEATURES``). The model is one lookup table per feature and one per chosen pair of
features: cyclic boosting fits a shallow tree to one feature after the other, with a small step, and adds its leaves to that feature's
table; then pairs are picked by how much a cut in four of their plane would still explain, and boosted likewise. A score is
the sigmoid of the sum of the looked-up bins.
"""

from __future__ import annotations

import operator
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apisurface.llm.frames import fresh, in_arrow, pick, sliced, stored
from apisurface.llm.sampling import bounded_sample

FEATURES = (
    "log_chars",
    "upper_share",
    "digit_share",
    "plain_sign_share",
    "exclaim_share",
    "odd_sign_share",
    "space_share",
    "word_length",
    "distinct_words",
    "distinct_triples",
    "top_word_share",
    "repeat_share",
    "capital_words",
    "letterless_words",
    "distinct_lines",
    "line_length",
)
LOWER, UPPER, DIGIT, SIGN, EXCLAIM, ODD, SPACE = range(7)
PLAIN_SIGNS = frozenset(".,;:?'\"()-")
#: Texts are read in chunks of about so many characters, cut at white space, whose counts add up; only one is taken apart at a time.
CHUNK = 1 << 18
PREDICTED_FROM = 0.3


def _kind(char: str) -> int:
    category = unicodedata.category(char)
    if category in ("Lu", "Lt"):
        return UPPER
    if category[0] in "LM":
        return LOWER
    if category[0] == "N":
        return DIGIT
    if char.isspace():
        return SPACE
    return EXCLAIM if char == "!" else SIGN if char in PLAIN_SIGNS else ODD


#: Kind of each code point of the first plane; those beyond count as odd signs.
KINDS = np.array([_kind(chr(c)) for c in range(1 << 16)] + [ODD], np.uint8)


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the labelled rows that training sees, the rest is the shape of the model."""

    sample_rows: int = 20_000
    bins: int = 48
    pair_bins: int = 12
    pairs: int = 8
    rounds: int = 150
    patience: int = 15
    rate: float = 0.15
    least_rows: float = 8.0
    smoothing: float = 1.0
    held_back: float = 0.15
    seed: int = 11


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 of each row of features: bins looked up and added, all rows at a time."""
        total = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], side="right")]
        if self.pairs:
            coarse = [np.searchsorted(self.pair_edges[f], x[:, f], side="right") for f in range(x.shape[1])]
            for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
                total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-total))


def _chunks(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > CHUNK:
        cut = start + CHUNK
        end = max(text.rfind(" ", start + CHUNK // 2, cut), text.rfind("\n", start + CHUNK // 2, cut)) + 1 or cut
        yield text[start:end]
        start = end
    yield text[start:]


def describe(text: str | None) -> tuple[float, ...]:
    """The figures named in ``FEATURES``; all zero for a text that is null or empty.

    Distinct words, triples and lines, and the share of the commonest word, are counted within each chunk and added up.
    """
    kinds = np.zeros(7, np.int64)
    words = triples = lines = 0
    distinct_words = distinct_triples = distinct_lines = top = repeats = capitals = letterless = 0
    for chunk in _chunks(text or ""):
        codes = np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds += np.bincount(KINDS[np.minimum(codes, len(KINDS) - 1)], minlength=7)
        here = chunk.split()
        if not here:
            continue
        counted = Counter(here)
        words += len(here)
        distinct_words += len(counted)
        top += max(counted.values())
        repeats += sum(map(operator.eq, here, here[1:]))
        capitals += sum(map(str.isupper, here))
        letterless += sum(n for w, n in counted.items() if not any(map(str.isalpha, w)))
        triples += max(len(here) - 2, 1)
        distinct_triples += len(set(zip(here, here[1:], here[2:], strict=False))) or 1
        told = [line for line in chunk.split("\n") if line and not line.isspace()]
        lines += len(told)
        distinct_lines += len(set(told))
    chars = int(kinds.sum())
    if not words:
        return (float(np.log1p(chars)), *([0.0] * (len(FEATURES) - 1)))
    visible = chars - int(kinds[SPACE])
    letters = max(int(kinds[LOWER] + kinds[UPPER]), 1)
    return (
        float(np.log1p(chars)),
        int(kinds[UPPER]) / letters,
        int(kinds[DIGIT]) / chars,
        int(kinds[SIGN]) / chars,
        int(kinds[EXCLAIM]) / chars,
        int(kinds[ODD]) / chars,
        int(kinds[SPACE]) / chars,
        visible / words,
        distinct_words / words,
        distinct_triples / triples,
        top / words,
        repeats / words,
        capitals / words,
        letterless / words,
        distinct_lines / lines,
        visible / lines,
    )


def _gain(g: np.ndarray, h: np.ndarray, smoothing: float) -> np.ndarray:
    return g * g / (h + smoothing)


def best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray, settings: Settings) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins in two; place 0 and gain 0 if none helps."""
    left_g, left_h, left_n = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    if not len(left_g):
        return 0.0, 0
    all_g, all_h, all_n = g.sum(), h.sum(), n.sum()
    gain = _gain(left_g, left_h, settings.smoothing) + _gain(all_g - left_g, all_h - left_h, settings.smoothing)
    gain -= _gain(all_g, all_h, settings.smoothing)
    gain[(left_n < settings.least_rows) | (all_n - left_n < settings.least_rows)] = 0
    at = int(gain.argmax())
    return (float(gain[at]), at + 1) if gain[at] > 1e-9 else (0.0, 0)


def shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, settings: Settings) -> np.ndarray:
    """Step for each bin: a tree of depth two over one row of bins, its leaves Newton steps."""
    places = [0, len(g)]
    _, middle = best_cut(g, h, n, settings)
    if middle:
        places.append(middle)
        for low, high in ((0, middle), (middle, len(g))):
            _, cut = best_cut(g[low:high], h[low:high], n[low:high], settings)
            if cut:
                places.append(low + cut)
    step = np.zeros(len(g))
    places.sort()
    for low, high in zip(places, places[1:], strict=False):
        step[low:high] = -g[low:high].sum() / (h[low:high].sum() + settings.smoothing)
    return step


def pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, settings: Settings) -> tuple[float, np.ndarray]:
    """Gain and step for each cell of a plane of bins: one cut along one axis, then each side along the other."""
    whole = float(_gain(g.sum(), h.sum(), settings.smoothing))
    best, chosen = 1e-9, np.zeros_like(g)
    for turned in (False, True):
        a = np.stack([m.T if turned else m for m in (g, h, n)])
        if a.shape[1] < 2:
            continue
        # For each first cut, the sums of each part of both sides: left of every second cut, and all of the side.
        upper = np.cumsum(np.cumsum(a, axis=1)[:, :-1], axis=2)
        lower = np.cumsum(a.sum(1, keepdims=True), axis=2) - upper
        gain, cuts = np.zeros(a.shape[1] - 1), []
        for side in (upper, lower):
            whole_side = side[:, :, -1:]
            left = side[:, :, :-1]
            right = whole_side - left
            more = _gain(left[0], left[1], settings.smoothing) + _gain(right[0], right[1], settings.smoothing)
            uncut = _gain(whole_side[0], whole_side[1], settings.smoothing)
            more = np.where(np.minimum(left[2], right[2]) < settings.least_rows, uncut, more)
            more = np.concatenate([uncut, np.maximum(more, uncut)], axis=1)
            cuts.append(more.argmax(1))
            gain += np.where(whole_side[2, :, 0] < settings.least_rows, -np.inf, more.max(1))
        first = int(gain.argmax())
        if gain[first] - whole > best:
            best, step = float(gain[first] - whole), np.zeros(a.shape[1:])
            for rows, at in ((slice(0, first + 1), cuts[0][first]), (slice(first + 1, None), cuts[1][first])):
                for columns in (slice(0, at), slice(at, None)):
                    part = a[:, rows, columns].sum((1, 2))
                    step[rows, columns] = -part[0] / (part[1] + settings.smoothing)
            chosen = step.T if turned else step
    return best, chosen


def _loss(total: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y > 0, -total, total)).mean()) if len(y) else 0.0


def train(x: np.ndarray, y: np.ndarray, settings: Settings = Settings()) -> Model:
    """Fit on features and 0/1 labels; the rows must come in a fixed order for a fixed result.

    Rows held back say after which round to stop, for the features and again for the pairs. Without rows every score is 0.5;
    with one label only, tables stay empty and the score is that label's smoothed share.
    """
    width = x.shape[1]
    share = (y.sum() + 0.5) / (len(y) + 1)
    flat = Model(float(np.log(share / (1 - share))), [np.zeros(0)] * width, [np.zeros(1)] * width, [np.zeros(0)] * width, [], [])
    if len(np.unique(y)) < 2:
        return flat
    order = np.random.default_rng(settings.seed).permutation(len(y))
    n_held = int(len(y) * settings.held_back)
    held, used = order[:n_held], order[n_held:]
    if not n_held:
        held = used

    def cut_at(bins: int) -> list[np.ndarray]:
        return [np.unique(np.quantile(x[used, f], np.arange(1, bins) / bins)) for f in range(width)]

    def placed(edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(edges[f], x[:, f], side="right") for f in range(width)]

    edges, pair_edges = cut_at(settings.bins), cut_at(settings.pair_bins)
    fine, coarse = placed(edges), placed(pair_edges)
    total = np.full(len(y), flat.intercept)

    def sums(cells: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total[used]))
        at = cells[used]
        n = np.bincount(at, minlength=size).astype(float)
        return np.bincount(at, p - y[used], size), np.bincount(at, p * (1 - p), size), n

    def boosted(cells: list[np.ndarray], shapes: list[tuple[int, ...]], grow) -> list[np.ndarray]:
        nonlocal total
        tables = [np.zeros(shape) for shape in shapes]
        best, start, kept, since = _loss(total[held], y[held]), total.copy(), [t.copy() for t in tables], 0
        for _ in range(settings.rounds if shapes else 0):
            for f, shape in enumerate(shapes):
                g, h, n = (s.reshape(shape) for s in sums(cells[f], int(np.prod(shape))))
                step = settings.rate * grow(g, h, n)
                tables[f] += step
                total += step.reshape(-1)[cells[f]]
            now, since = _loss(total[held], y[held]), since + 1
            if now < best - 1e-6:
                best, start, kept, since = now, total.copy(), [t.copy() for t in tables], 0
            elif since >= settings.patience:
                break
        total = start
        return kept

    tables = boosted(fine, [(len(e) + 1,) for e in edges], lambda g, h, n: shallow_tree(g, h, n, settings))
    sizes = [len(e) + 1 for e in pair_edges]
    found = []
    for a, b in combinations(range(width), 2):
        cells = coarse[a] * sizes[b] + coarse[b]
        plane = [s.reshape(sizes[a], sizes[b]) for s in sums(cells, sizes[a] * sizes[b])]
        found.append((pair_tree(*plane, settings)[0], a, b, cells))
    found.sort(key=lambda t: (-t[0], t[1], t[2]))
    chosen = [t for t in found[: settings.pairs] if t[0] > 1e-9]
    shapes = [(sizes[a], sizes[b]) for _, a, b, _ in chosen]
    pair_tables = boosted([t[3] for t in chosen], shapes, lambda g, h, n: pair_tree(g, h, n, settings)[1])
    return Model(flat.intercept, edges, tables, pair_edges, [(a, b) for _, a, b, _ in chosen], pair_tables)


def held_out(id_col: str) -> F.Column:
    """Whether a row belongs to the part that is never learned from: crc32 of the id as text, modulo 5, is 0; null ids are not."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, settings: Settings = Settings()) -> Model:
    """Model from at most ``settings.sample_rows`` labelled texts, held-out ids left aside.

    The sample is that of the smallest hashes, drawn from the labels (ids and labels only), so documents are read where they lie,
    without a shuffle; it is drawn once more from what the documents of these ids give, which a repeated id may make large.
    Rows without id or with a label other than 0 and 1 take no part. Equal labelled texts of one id count once.
    """
    marks = pick(labels, _id=id_col, _label=label_col).where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1))
    marks = marks.where(~held_out("_id")).select("_id", F.col("_label").cast("int").alias("_label"))
    chosen = stored(bounded_sample(marks, settings.sample_rows, ["_id", "_label"]), "labelled")
    texts = pick(docs, _id=id_col, _text=text_col)
    # At most sample_rows ids and labels of fixed size are broadcast.
    told = texts.join(F.broadcast(chosen), "_id").select("_label", F.sha2("_text", 256).alias("_sha"), "_id", "_text")

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [describe(text) for text in batch.column(3).to_pylist()]
            packed = pa.array([np.array(r).tobytes() for r in rows], pa.binary())
            key = batch.column(2).cast(pa.string())
            yield pa.record_batch([batch.column(0), batch.column(1), key, packed], ["label", "sha", "key", "figures"])

    seen = stored(in_arrow(told, figures, "label int, sha string, key string, figures binary"), "figures")
    found = bounded_sample(seen, settings.sample_rows, ["key", "sha", "label"]).collect()
    found = sorted((r["key"], r["sha"] or "", r["label"], bytes(r["figures"])) for r in found)
    x = np.array([np.frombuffer(r[3]) for r in found]).reshape(len(found), len(FEATURES))
    return train(x, np.array([r[2] for r in found], float), settings)


def score(docs: DataFrame, text_col: str, model: Model) -> DataFrame:
    """``docs`` with ``score`` (chance of label 1) and ``predicted`` (1 from 0.3 on, else 0); one row for each row, all columns kept.

    A null text is scored as an empty one, which has figures of its own (all zero); long texts are read whole, in chunks. Equal
    texts get equal scores. Columns of these names that are already there are replaced. An empty table gives no rows.
    """
    source = docs.drop("score", "predicted")
    text_name = fresh("_text_in", source.columns)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            last = batch.num_columns - 1
            x = np.array([describe(text) for text in batch.column(last).to_pylist()]).reshape(-1, len(FEATURES))
            p = model.score(x)
            kept = [batch.column(i) for i in range(last)]
            new = [pa.array(p, pa.float64()), pa.array((p >= PREDICTED_FROM).astype(np.int32), pa.int32())]
            yield pa.record_batch([*kept, *new], [*batch.schema.names[:-1], "score", "predicted"])

    fields = [*source.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return in_arrow(source.select("*", F.col(f"`{text_col}`").alias(text_name)), judge, T.StructType(fields))
