"""Query of the exact search over all vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apisurface.llm import topk_search
from apisurface.llm.frames import table
from apisurface.llm.queries import query

SCALE, BEST, EVERY = 1024, 10, 100


@query(
    "op1_topk_search",
    f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % {EVERY} = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {BEST}
""",
)
def op1_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    rows = rows.select("vec_id", topk_search.floored(F.col("embedding"), SCALE).alias("v"))
    return topk_search.top_k(rows, rows.where(F.col("vec_id") % EVERY == 0), "vec_id", "v", BEST)
