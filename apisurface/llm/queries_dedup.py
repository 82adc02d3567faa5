"""Queries of the dedup operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apisurface.llm import line_dedup, ngram_join, suffix_dedup
from apisurface.llm.frames import table
from apisurface.llm.queries import query


@query(
    "op2_line_dedup",
    r"""
WITH cut AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM cut
), wins AS (
  SELECT doc_id, pos, line || chr(10) || lead(line) OVER w || chr(10) || lead(line, 2) OVER w AS win
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS n
  FROM wins WHERE win IS NOT NULL AND trim(replace(win, chr(10), '')) <> ''
), gone AS (
  SELECT DISTINCT doc_id, pos + d AS pos FROM ranked, (SELECT unnest([0, 1, 2]) AS d) WHERE n > 1
), kept AS (
  SELECT l.doc_id, l.line, l.pos, g.pos IS NULL AS stays FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (NOT stays)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM kept GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, sha256('') FROM documents WHERE text IS NULL
""",
)
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    kept = line_dedup.remove_repeated_lines(docs, "doc_id", "text")
    return kept.select(
        "doc_id",
        F.col("n_lines").cast("bigint").alias("n_lines"),
        F.col("n_removed_lines").cast("bigint").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = suffix_dedup.find_repeats(docs, "doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query(
    "op5_ngram_join",
    r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE text IS NOT NULL
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
  FROM words, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * shared >= 85 * (p.n + q.n - shared)
), reach AS (
  SELECT doc_id AS root, doc_id AS node FROM documents
  UNION SELECT root, y FROM reach JOIN links ON x = node
)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes z USING (doc_id)
JOIN (SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY node) r USING (doc_id)
""",
)
def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return ngram_join.near_classes(docs, "doc_id", "text", words=4, similarity=(85, 100))
