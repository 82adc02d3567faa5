"""Running counters over result streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from apisurface.operators.aggregates import UNKNOWN_PROVIDER


def stream_results(spark: SparkSession, path: str, schema: str, format: str = "parquet", files_per_batch: int = 64) -> DataFrame:
    """Result files as a stream, a bounded number of files per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(format).load(path)


def stream_counters(stream: DataFrame, keys: Sequence[str] = ("provider",), failed: str | None = None) -> DataFrame:
    """Running row counts per key, null and empty keys as ``<unknown>``, and failures when asked for."""
    labels = [F.coalesce(F.nullif(F.col(k), F.lit("")), F.lit(UNKNOWN_PROVIDER)).alias(k) for k in keys]
    measures = [F.count(F.lit(1)).alias("functions")]
    if failed is not None:
        measures.append(F.count_if(F.col(failed)).alias("failed"))
    return stream.groupBy(*labels).agg(*measures)


def stream_mean(stream: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Running number of completed items and mean time per item."""
    return stream.groupBy(*keys).agg(F.count(col).alias("completed"), F.avg(col).alias("mean"))


def run_available(counters: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Run a counter stream over everything available into the in-memory table ``name``."""
    query = (
        counters.writeStream.outputMode(mode)
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def without_repeats(stream: DataFrame, ids: Sequence[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Rows of a stream once each: repeats by ``ids`` that come within ``delay`` of event time are dropped, older state is given up."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(ids))


def write_partials(
    stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = (), failed: str | None = None, value: str | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Partial counters of each micro-batch as Parquet below ``path``, in a folder named by the number of the batch.

    A batch that runs again after a restart replaces its own folder, so totals do not depend on where a stream was
    stopped. Rows are aggregated and written by tasks; the driver sees batch numbers only. Keys null and empty are ``<unknown>``.
    """
    labels = [F.coalesce(F.nullif(F.col(k).cast("string"), F.lit("")), F.lit(UNKNOWN_PROVIDER)).alias(k) for k in keys]
    measures = [F.count(F.lit(1)).alias("functions")]
    if failed is not None:
        measures.append(F.count_if(F.col(failed)).alias("failed"))
    if value is not None:
        measures += [F.count(value).alias("completed"), F.sum(F.col(value).cast("double")).alias("total")]

    def replace(batch: DataFrame, number: int) -> None:
        batch.groupBy(*labels).agg(*measures).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_totals(spark: SparkSession, path: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counters added up over all batches written so far; ``mean`` where values were counted."""
    parts = spark.read.option("mergeSchema", True).parquet(path)
    measures = [F.sum(c).alias(c) for c in ("functions", "failed", "completed") if c in parts.columns]
    if "total" in parts.columns:
        measures.append((F.sum("total") / F.nullif(F.sum("completed"), F.lit(0))).alias("mean"))
    return parts.groupBy(*keys).agg(*measures)
