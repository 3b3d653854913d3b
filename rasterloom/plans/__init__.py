"""Registered queries and their SQL."""

from . import linear_queries, pixel_queries, resample_queries, row_queries, shape_queries, sql_queries, tile_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
