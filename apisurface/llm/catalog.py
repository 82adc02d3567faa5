"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from apisurface.llm import queries as numbered
from apisurface.llm import queries_dedup, queries_records, queries_search  # noqa: F401  these register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**numbered.QUERIES, "pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    found = dict(numbered.ORACLES)
    if corpus_pipeline.ORACLE_SQL is not None:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
