"""All queries of the engine and their DuckDB equivalents, by name."""

from __future__ import annotations

from weft.plans import documents, kernels, rasters, reports, structures, texts  # noqa: F401  they register their queries
from weft.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
