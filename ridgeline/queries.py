"""All registered queries of the library."""

from __future__ import annotations

from . import queries_documents, queries_fits, queries_imports, queries_joins, queries_maps, queries_places, queries_rides, queries_streams, queries_time, queries_totals, queries_winds  # noqa: F401  (register)
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
