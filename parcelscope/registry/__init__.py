"""Every registered query with its DuckDB text."""

from . import blocks, columns, questions, small_tables  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
