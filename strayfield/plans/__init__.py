"""Queries by area; importing this package registers them."""

from . import coverage_queries, eval_queries, feed_queries, match_queries, report_queries, search_queries, store_queries, streaming_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
