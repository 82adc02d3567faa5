"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text is lower-cased, its letters kept and everything else turned into single blanks; its features are all byte
n-grams of that string, hashed to buckets. The model is an embedding per bucket, averaged over the text, and
a linear layer with softmax, trained by stochastic gradient descent in numpy on a bounded sample. One more class stands for
all other languages: its examples are the rows themselves with their buckets dealt anew at random, which is what a language
looks like that shares no n-grams with the learned ones. Scores are calibrated on rows held back from training and on such
examples of them: a temperature is fitted to them, and the score below which a text is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apisurface.llm.frames import fresh, in_arrow, pick, sliced
from apisurface.llm.hashing import BYTE_VALUES, mix
from apisurface.llm.sampling import hash_place, share_cut

UNDETERMINED = "und"
NOT_LETTER = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """``sample_per_language`` and ``sample_rows`` bound the labelled rows that training sees, the rest is the shape of the model."""

    sample_per_language: int = 600
    sample_rows: int = 20_000
    max_languages: int = 400
    buckets: int = 1 << 14
    dimensions: int = 16
    orders: tuple[int, ...] = (2, 3, 4)
    epochs: int = 12
    batch: int = 16
    rate: float = 4.0
    held_back: float = 0.2
    reject_share: float = 0.002
    seed: int = 7


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    settings: Settings


def clean(text: str | None) -> bytes:
    """Lower-cased letters with single blanks between and around; empty if there is no letter."""
    words = NOT_LETTER.sub(" ", (text or "").lower()).strip()
    return f" {words} ".encode("utf-8", "surrogatepass") if words else b""


def feature_counts(data: bytes, settings: Settings) -> np.ndarray:
    """How often each bucket occurs among the n-grams of ``data``; whole texts, whatever their length."""
    values = BYTE_VALUES[np.frombuffer(data, np.uint8)]
    total = np.zeros(settings.buckets, np.int64)
    grown = values
    for n in range(2, max(settings.orders) + 1):
        if len(data) < n:
            break
        grown = grown[:-1] * np.uint64(0x9E3779B97F4A7C15) + values[n - 1 :]
        if n in settings.orders:
            cells = (mix(grown + np.uint64(n)) & np.uint64(settings.buckets - 1)).astype(np.int32)
            total += np.bincount(cells, minlength=settings.buckets)
    return total


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Rows:
    """Rows of features, of which only the filled cells are held; indexing gives some of them in full."""

    def __init__(self, cells: list[np.ndarray], values: list[np.ndarray], width: int) -> None:
        self.cells, self.values, self.shape = cells, values, (len(cells), width)

    def __getitem__(self, which: np.ndarray) -> np.ndarray:
        out = np.zeros((len(which), self.shape[1]), np.float32)
        for row, i in zip(out, which, strict=True):
            row[self.cells[i]] = self.values[i]
        return out


#: Rows that are held in full at a time when a fitted model is checked.
CHECKED_ROWS = 256


def with_others(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rows, and behind them the same rows as of a language that shares no n-grams: their buckets dealt anew."""
    return np.concatenate([x, x[:, rng.permutation(x.shape[1])]])


def rejection(right: np.ndarray, foreign: np.ndarray, share: float) -> float:
    """The score below which a text is rejected, from scores of rows judged right and of examples of other languages.

    Not more than ``share`` of the rows judged right lie below it. If it can, it lies half way (in log odds, no odds being
    surer than so many rows can show) between them and all but ``share`` of the others.
    """
    least = 1 / (len(right) + 2)
    low, high = (np.clip(q, least, 1 - least) for q in (np.quantile(right, share), np.quantile(foreign, 1 - share)))
    if high >= low:
        return float(low)
    odds = (np.log(low / (1 - low)) + np.log(high / (1 - high))) / 2
    return float(1 / (1 + np.exp(-odds)))


def train(features: np.ndarray | Rows, labels: list[str], settings: Settings) -> Model:
    """Fit on mean feature vectors (rows sum to one); the rows must come in a fixed order for a fixed result.

    The last column of ``table`` and ``bias`` is the class of other languages.
    """
    languages = sorted(set(labels))
    y = np.searchsorted(languages, labels)
    rng = np.random.default_rng(settings.seed)
    order = rng.permutation(len(y))
    n_held = int(len(y) * settings.held_back)
    held, used = order[:n_held], order[n_held:]
    embedding = rng.normal(0, 0.5, (settings.buckets, settings.dimensions))
    other = len(languages)
    weights = np.zeros((settings.dimensions, other + 1))
    bias = np.zeros(other + 1)
    steps = max(1, settings.epochs * -(-len(used) // settings.batch))
    done = 0
    for _ in range(settings.epochs):
        for part in np.array_split(rng.permutation(used), max(1, -(-len(used) // settings.batch))):
            if not len(part):
                continue
            rate = settings.rate * (1 - done / steps)
            x = with_others(features[part], rng)
            wanted = np.concatenate([y[part], np.full(len(part), other)])
            hidden = x @ embedding
            error = softmax(hidden @ weights + bias)
            error[np.arange(len(x)), wanted] -= 1
            error /= len(part)
            back = error @ weights.T
            weights -= rate * hidden.T @ error
            bias -= 0.1 * rate * error.sum(axis=0)
            seen = np.flatnonzero(x.any(axis=0))
            embedding[seen] -= rate * 20 * (x[:, seen].T @ back)
            done += 1
    table = embedding @ weights
    checked = held if n_held else used
    parts = [with_others(features[checked[i : i + CHECKED_ROWS]], rng) @ table + bias for i in range(0, len(checked), CHECKED_ROWS)]
    # Rows of all parts first, then the examples of other languages.
    logits = np.concatenate([p[: len(p) // 2] for p in parts] + [p[len(p) // 2 :] for p in parts])
    truth = np.concatenate([y[checked], np.full(len(checked), other)])
    temperatures = np.geomspace(0.05, 20, 60)
    rows = np.arange(len(truth))
    losses = [-np.log(softmax(logits / t)[rows, truth] + 1e-12).mean() for t in temperatures]
    temperature = float(temperatures[int(np.argmin(losses))]) if len(rows) else 1.0
    scores = softmax(logits / temperature)[:, :other]
    known, foreign = scores[: len(checked)], scores[len(checked) :].max(axis=1)
    right = known[known.argmax(axis=1) == y[checked]].max(axis=1)
    threshold = rejection(right, foreign, settings.reject_share) if len(right) else 0.0
    return Model(languages, table.astype(np.float32), bias, temperature, threshold, settings)


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, settings: Settings = Settings()) -> Model:
    """Model from at most ``sample_per_language`` rows of each of at most ``max_languages`` languages, ``sample_rows`` in all.

    The sample is that of the smallest hashes of id and text, so it is the same in every run; rows equal in these count once. Languages are
    counted by a sketch, which gives the hash below which somewhat more than the wanted rows lie; only these are moved and ranked, so
    no language, id or group of copies meets in one task. Texts leave their task as counts of buckets. Rows without label or letters
    are not used. Without any usable row the model knows no language.
    """
    rows = pick(labelled, _id=id_col, _text=text_col, _lang=lang_col).where(F.col("_lang").isNotNull())
    rows = rows.withColumn("_hash", hash_place(["_id", "_text"]))
    counted = rows.groupBy("_lang").agg(F.approx_count_distinct("_hash", 0.03).alias("n"))
    told = counted.orderBy(F.desc("n"), "_lang").limit(settings.max_languages).collect()
    if not told:
        return Model([], np.zeros((settings.buckets, 0), np.float32), np.zeros(0), 1.0, 0.0, settings)
    wanted = max(1, min(settings.sample_per_language, settings.sample_rows // len(told)))
    limits = F.create_map(*[F.lit(x) for r in told for x in (r["_lang"], share_cut(wanted, r["n"]))])
    near = rows.where(F.col("_hash") <= limits[F.col("_lang")]).dropDuplicates(["_lang", "_hash"])
    place = F.row_number().over(Window.partitionBy("_lang").orderBy("_hash"))
    sample = near.withColumn("_rank", place).where(F.col("_rank") <= wanted)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for key, lang, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if data := clean(text):
                    total = feature_counts(data, settings)
                    cells = np.flatnonzero(total)
                    out.append((key, lang, cells.astype(np.int32).tobytes(), total[cells].astype(np.int32).tobytes()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            types = (pa.int64(), pa.string(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["h", "lang", "cells", "n"])

    found = in_arrow(sample.select("_hash", "_lang", "_text"), counts, "h long, lang string, cells binary, n binary").collect()
    found = sorted(found, key=lambda r: (r["h"], r["lang"], bytes(r["cells"]), bytes(r["n"])))
    if not found:
        return Model([], np.zeros((settings.buckets, 0), np.float32), np.zeros(0), 1.0, 0.0, settings)
    cells, values = [], []
    for r in found:
        n = np.frombuffer(r["n"], np.int32)
        cells.append(np.frombuffer(r["cells"], np.int32))
        values.append((n / n.sum()).astype(np.float32))
    features = Rows(cells, values, settings.buckets)
    return train(features, [r["lang"] for r in found], settings)


def predict(docs: DataFrame, text_col: str, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``; one row for each row, all columns kept.

    A text that is null or has no letter gets ``und``, score 0 and is rejected, as does every text if the model knows no
    language, and every text whose score lies below the threshold of the model: one in a language that was not learned,
    or mere letters. Its ``lang_pred`` is the language that comes nearest. Ties go to the language first in order. Columns of these names
    that are already there are replaced. Equal texts are judged alike.
    """
    source = docs.drop("lang_pred", "score", "rejected")
    text_name = fresh("_text_in", source.columns)
    languages, table, settings = model.languages, model.table, model.settings

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            preds, scores, rejected = [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                data = clean(text)
                if not data or not languages:
                    preds.append(UNDETERMINED)
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                total = feature_counts(data, settings)
                filled = np.flatnonzero(total)
                p = softmax((total[filled] @ table[filled] / total.sum() + model.bias) / model.temperature)
                best = int(p[: len(languages)].argmax())
                preds.append(languages[best])
                scores.append(float(p[best]))
                rejected.append(bool(p[best] < model.threshold))
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            new = [pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.record_batch([*kept, *new], [*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    schema = T.StructType(
        [
            *source.schema.fields,
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("rejected", T.BooleanType()),
        ]
    )
    return in_arrow(source.select("*", F.col(f"`{text_col}`").alias(text_name)), judge, schema)


def held_out(id_col: str) -> F.Column:
    """Whether a row belongs to the part that is never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))
