"""A corpus made ready for training: language, repeated lines, near copies, repeated strings, packed sequences.

``run`` applies the stages to ``documents`` in turn; each writes its result, which the next one reads.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apisurface.llm import language_id, line_dedup, ngram_join, packing, suffix_dedup
from apisurface.llm.frames import fresh, stored
from apisurface.ordered import with_global_rank

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
WINDOW = 4096


def _with_new_text(changed: DataFrame, was_cut, columns: list[str]) -> DataFrame:
    """Rows whose text is left blank by cuts go; the length column follows the text."""
    kept = changed.where(~was_cut | (F.trim(F.translate("text", "\n\t\r", "   ")) != "") | F.col("text").isNull())
    size = F.when(was_cut, F.length("text")).otherwise(F.col("n_chars")) if "n_chars" in columns else None
    return kept.select(*[size.cast(changed.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model, fitted on a bounded sample of those with a label, does not reject."""
    model = language_id.fit(docs.where(~language_id.held_out("doc_id")), "doc_id", "text", "lang")
    return language_id.predict(docs, "text", model).where(~F.col("rejected")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less windows of three lines that appeared before; such as had nothing else go."""
    cut = line_dedup.remove_repeated_lines(docs, "doc_id", "text")
    return _with_new_text(cut, F.col("n_removed_lines") > 0, docs.columns)


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) one row, that of smallest id.

    Every row is a node of its own, known by its place in the order of ids: ids that are null or repeated tie nothing together. Null ids
    count as the smallest; rows of one id follow the hash of their text, then the other columns. Of equal rows one stays.
    Texts without words have no copies and all stay.
    """
    key = fresh("_key", docs.columns)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    salted = docs.withColumn(f"{key}_salt", F.rand(5))
    rows = with_global_rank(salted, ["doc_id", F.xxhash64("text"), *others, F.col(f"{key}_salt")], key).drop(f"{key}_salt")
    classes = ngram_join.near_classes(rows, key, "text", words=5, similarity=(4, 5))
    kept = classes.where((F.col("n_shingles") == 0) | (F.col("component_id") == F.col("doc_id"))).select(F.col("doc_id").alias(key))
    return rows.join(kept, key, "left_semi").select(*docs.columns)


def dedup_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less what strings of 100 bytes that start earlier cover; such as had nothing else go."""
    cut = suffix_dedup.remove_repeats(docs, "doc_id", "text")
    return _with_new_text(cut, F.col("repeated"), docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    return packing.pack(docs, "doc_id", "text", packing.WordTokenizer(TOKENIZER, END_ID), WINDOW)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_join", join_ngrams),
    ("suffix_dedup", dedup_strings),
    ("packing", pack_tokens),
]

#: The stages hold a trained model and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
