"""All registered queries in one place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from apisurface.plans import bound_files, bound_flows, bound_joins, bound_order, bound_rows, bound_text, registry

MODULES = (bound_rows, bound_files, bound_joins, bound_order, bound_text, bound_flows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracles() -> dict[str, str]:
    return dict(registry.ORACLES)
