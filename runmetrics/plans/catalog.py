"""All registered queries with their SQL."""

from . import catalog_functions, catalog_graph, catalog_integrity, catalog_io, catalog_kept, catalog_metrics, catalog_reports, catalog_results  # noqa: F401
from .oracle import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
