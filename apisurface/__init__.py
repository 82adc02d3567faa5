"""API-surface analytics on Spark: catalogs, call facts, signatures and measurements as DataFrames."""

from apisurface.session import build_session, cut_lineage, shared_folder

__all__ = ["build_session", "cut_lineage", "shared_folder"]
