"""Readers: parquet tables, text reports, page range specs, markup and form data."""

from weft.sources.tables import read_table

__all__ = ["read_table"]
