"""Queries of the quality model, the manifest and the repair of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apisurface.llm import conversation_repair, merkle_manifest, quality_gam
from apisurface.llm.frames import table
from apisurface.llm.queries import query


def crc32_sql(text: str) -> str:
    """SQL of the unsigned crc32 of a text of ASCII characters, with the table ``crc`` (``CRC_SQL``) in reach."""
    bytes_of = f"list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)"
    folded = f"list_reduce({bytes_of}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)"
    return f"xor({folded}, 4294967295::BIGINT)"


#: The 256 remainders of crc32, from its polynomial.
CRC_SQL = """bits AS (
  SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8)"""


@query("op11_quality_gam")
def op11_quality_gam(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality_gam.fit(docs, table(spark, folder, "labels"), "doc_id", "text", "quality")
    return quality_gam.score(docs, "text", model).select("doc_id", quality_gam.held_out("doc_id").alias("held_out"), "score", "predicted")


def framed_sql(field: str) -> str:
    return f"CASE WHEN {field} IS NULL THEN '-' ELSE strlen({field}::VARCHAR) || ':' || {field} END"


def leaf_sql(size: str) -> str:
    return f"sha256({' || '.join(framed_sql(f) for f in ('doc_id', 'source', 'lang', size, 'text'))})"


def level_sql(name: str, start: str) -> str:
    return f"""{name} AS (
  {start}
  UNION ALL SELECT tree, level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (n + 1) // 2
  FROM {name} WHERE n > 1 GROUP BY tree, level, place // 2, n
)"""


def fold_sql(name: str, start: str, nodes: str) -> str:
    return f"""{name} AS (
  {start}
  UNION ALL SELECT f.row, f.tree, f.level + 1, f.place // 2, (f.n + 1) // 2,
    sha256(CASE WHEN s.h IS NULL THEN f.h WHEN f.place % 2 = 0 THEN f.h || s.h ELSE s.h || f.h END), f.proof || coalesce(s.h, '')
  FROM {name} f LEFT JOIN {nodes} s ON s.tree = f.tree AND s.level = f.level AND s.place = xor(f.place, 1) WHERE f.n > 1
)"""


@query(
    "op12_merkle_manifest",
    f"""
WITH RECURSIVE {CRC_SQL}, told AS (
  SELECT row_number() OVER () AS row, doc_id, lang, {leaf_sql("n_chars")} AS leaf,
    CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 7 = 0 THEN {leaf_sql("(n_chars + 1)")} END AS tampered
  FROM documents, crc
), leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY lang) AS n,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
  FROM told
), {level_sql("nodes", "SELECT tree, 0 AS level, place, leaf AS h, n FROM leaves")},
roots AS (SELECT tree, h AS subroot, count(*) OVER () AS n FROM nodes WHERE n = 1),
{level_sql("top", "SELECT -1 AS tree, 0 AS level, tree AS place, subroot AS h, n FROM roots")},
{fold_sql("low", "SELECT row, tree, 0 AS level, place, n, coalesce(tampered, leaf) AS h, '' AS proof FROM leaves", "nodes")},
{fold_sql("high", "SELECT row, -1 AS tree, 0 AS level, low.tree AS place, roots.n, h, proof FROM low JOIN roots USING (tree) WHERE low.n = 1", "top")}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, high.h AS folded_root, high.h = root AS verified
FROM leaves JOIN roots USING (tree) JOIN high USING (row), (SELECT h AS root FROM top WHERE n = 1) WHERE high.n = 1
""",
)
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    docs = table(spark, folder, "documents").select(*fields)
    leaf = merkle_manifest.leaf_digest([F.col(f) for f in fields])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = [F.col(f) + 1 if f == "n_chars" else F.col(f) for f in fields]
    tampered = F.when(hit, merkle_manifest.leaf_digest(changed))
    built = merkle_manifest.build(docs, "doc_id", "lang", leaf, {"tampered": tampered})
    proofs = merkle_manifest.prove(built, ["tampered"])
    folded = proofs.withColumn("folded_root", merkle_manifest.fold_proof(F.coalesce("tampered", "leaf"), F.col("proof")))
    return folded.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join("proof.digest", "").cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


#: The role that comes next behind a state, ``e`` being the start, and the states themselves by number of inserted rows.
NEXT_SQL = "CASE WHEN {state} = 'u' THEN 'a' ELSE 'u' END"
AFTER_SQL = """CASE k WHEN 0 THEN st WHEN 1 THEN CASE WHEN st = 'u' THEN 'a' ELSE 'u' END
    ELSE CASE WHEN st = 'u' THEN 'u' ELSE 'a' END END"""
SAID_SQL = """CASE k WHEN 0 THEN '' WHEN 1 THEN CASE WHEN st = 'u' THEN chr(10) || 'assistant:' ELSE chr(10) || 'user:' END
    ELSE CASE WHEN st = 'u' THEN chr(10) || 'assistant:' || chr(10) || 'user:' ELSE chr(10) || 'user:' || chr(10) || 'assistant:' END END"""


@query(
    "op13_conversation_repair",
    f"""
WITH RECURSIVE {CRC_SQL}, hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS h
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hit JOIN (VALUES (0), (1)) c(k) ON k = 0 OR h = 3 WHERE h <> 0
), placed AS (
  SELECT *, md5(strlen(role) || ':' || role || text) AS d, substr(role, 1, 1) AS c,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(strlen(role) || ':' || role || text)) AS i
  FROM damaged
), counted_before AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM placed
), judged AS (
  SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair, CASE
    WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault
  FROM counted_before
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
), best AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 'e' AS st, {{'cost': 0::BIGINT, 'audit': '', 'said': ''}} AS b FROM conversations
  UNION ALL
  SELECT conv_id, i, st, min(b) FROM (
    SELECT conv_id, i, CASE op WHEN 'D' THEN st WHEN 'K' THEN c ELSE {NEXT_SQL.format(state="st")} END AS st,
      {{'cost': cost + CASE op WHEN 'D' THEN 3 WHEN 'K' THEN 0 ELSE 2 END + CASE WHEN op <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END,
       'audit': audit || op, 'said': said || CASE op WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text
         ELSE chr(10) || CASE WHEN st = 'u' THEN 'assistant:' ELSE 'user:' END || text END}} AS b
    FROM (
      SELECT p.conv_id, p.i + 1 AS i, {AFTER_SQL} AS st, b.cost + 2 * k AS cost, b.audit || repeat('I', k) AS audit,
        b.said || {SAID_SQL} AS said, j.role, j.text, j.c, j.fault
      FROM best p JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.i = p.i + 1, (VALUES (0), (1), (2)) ins(k)
    ), (VALUES ('K'), ('R'), ('D')) ops(op)
    WHERE op = 'D' OR (fault NOT IN ('blank', 'duplicate')
      AND (op = 'R' OR (c = 's' AND st = 'e') OR (c = 'u' AND st <> 'u') OR (c = 'a' AND st = 'u')))
  ) GROUP BY conv_id, i, st
), ended AS (
  SELECT conv_id, min(b) AS b FROM (
    SELECT p.conv_id, {AFTER_SQL} AS st, {{'cost': b.cost + 2 * k, 'audit': b.audit || repeat('I', k), 'said': b.said || {SAID_SQL}}} AS b
    FROM best p JOIN counted n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND n.n = p.i, (VALUES (0), (1), (2)) ins(k)
  ) WHERE st IN ('e', 'a') GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost,
  coalesce(b.audit, '') AS audit, sha256(coalesce(substr(b.said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
""",
)
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    hit = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(named.cast("binary")) % 20).alias("h"))
    damaged = hit.select(
        "conv_id",
        "turn",
        F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("h") == 0).alias("dropped"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("h") == 3, 2).otherwise(1))).alias("copy"),
    )
    plans, repaired = conversation_repair.repair(damaged, "conv_id", "turn", "role", "text", F.col("dropped"))
    told = conversation_repair.digests_in_order(repaired).withColumnRenamed("id", "told")
    joined = plans.join(told, plans["id"].eqNullSafe(told["told"]), "left")
    digest = F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    return joined.select(F.col("id").alias("conv_id"), *conversation_repair.PLAN, digest)
