"""Queries of the ten operators over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from apisurface.llm import chat_format, fingerprint, language_id, packing, sentencepiece_bpe, url_filter
from apisurface.llm.frames import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
END_ID = 2
RULES = (
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)
#: Pages that were reached through a campaign link make their canonical URL a listed one.
LISTED_MARK = "utm_source="


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def conversation_events(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of ``conversations`` as an event log, with the conversation that holds control strings.

    Turns of the assistant come in one of three ways by their place: streamed in two deltas; as a draft that is edited and then goes on; as
    a draft that is regenerated, which also takes back a next turn begun by then. Other turns are whole messages, some of them
    mistyped and edited. Every row is a turn of its own: rows of equal turn numbers follow each other in the order of
    role and text.
    """
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(tricky).alias("text"),
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = rows.unionByName(extra).withColumn("turn", place.cast("bigint"))
    own, role, text = F.col("turn"), F.col("role"), F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    first, rest = F.left(text, half), F.substring(text, half + 1, F.length(text))

    def event(step: int, kind: str, said, turn=own, by=role):
        """The ``step``-th event of a turn; a turn has eight numbers to itself."""
        seq = (own * 8 + step).alias("seq")
        return F.struct(turn.alias("turn"), by.alias("role"), seq, F.lit(kind).alias("kind"), said.alias("text"))

    nobody = F.lit(None).cast("string")
    streamed = F.array(event(0, "message", F.lit("")), event(1, "delta", first), event(2, "delta", rest))
    edited = F.array(event(0, "message", F.lit("draft </turn>")), event(1, "edit", first), event(2, "delta", rest))
    begun = event(1, "message", F.lit("taken back"), own + 1, nobody)
    anew = F.array(event(0, "message", F.lit("draft ###")), begun, event(2, "regenerate", text))
    mistyped = F.array(event(0, "message", F.lit("mistyped")), event(1, "edit", text))
    way = own % 3
    told = F.when(way == 0, streamed).when(way == 1, edited).otherwise(anew)
    log = F.when(role.eqNullSafe("assistant"), told).when(own % 5 == 0, mistyped).otherwise(F.array(event(0, "message", F.col("text"))))
    return rows.select("conv_id", F.explode(log).alias("e")).select("conv_id", "e.*")


@query(
    "op4_chat_format",
    r"""
WITH told AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), shown AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '###', '#\##') AS body FROM told
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(body) + 14)::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
""",
)
def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rendered = chat_format.render(chat_format.fold_turns(conversation_events(spark, folder)))
    turns = chat_format.read_back(F.col("formatted"))
    learned = chat_format.masked_text(F.col("formatted"), F.col("loss_spans"))
    read = rendered.select("conv_id", "formatted", turns.alias("turns"), learned.alias("learned"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query("op6_packing")
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    tokenize = packing.WordTokenizer(WORD_TOKENIZER, END_ID)
    pieces = packing.pack(table(spark, folder, "documents"), "doc_id", "text", tokenize)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


RULE_SQL = "\n".join(
    f"    WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN '{r.name}'"
    for r in sorted(RULES, key=lambda r: (-len(r.name), r.name))
)
KEY_SQL = """CASE WHEN {host} <> '' THEN regexp_replace(regexp_replace({host}, '^(www|m)\\.', ''), ':\\d*$', '')
    || regexp_replace(regexp_replace({path}, '\\.html?$', ''), '/+$', '') END""".format(host="host", path="path")


@query(
    "op7_url_filter",
    f"""
WITH parts AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{url_filter.UPPER}', '{url_filter.LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), keyed AS (SELECT *, {KEY_SQL} AS k FROM parts),
listed AS (
  SELECT DISTINCT k FROM keyed WHERE k IS NOT NULL AND contains(url, '{LISTED_MARK}')
), ruled AS (
  SELECT *, CASE
{RULE_SQL}
    END AS rule FROM keyed
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ({", ".join(f"'{r.name}'" for r in RULES if r.verdict == "allow")}) THEN 'allow'
    WHEN rule IS NOT NULL OR k IN (SELECT k FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
""",
)
def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    listed = pages.where(F.col("url").contains(LISTED_MARK))
    judged = url_filter.filter_urls(pages, listed, "page_id", "url", "url", RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op8_fingerprint")
def op8_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.fingerprint_edits(table(spark, folder, "documents"), "doc_id", "text")


@query("op9_sentencepiece")
def op9_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    coded = sentencepiece_bpe.encode_decode(table(spark, folder, "documents"), "doc_id", "text", PIECE_MODEL)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op10_language_id")
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(~language_id.held_out("doc_id")), "doc_id", "text", "lang")
    judged = language_id.predict(docs.select("doc_id", "text"), "text", model)
    return judged.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
