"""All registered queries."""

from . import (  # noqa: F401
    catalog_crawl,
    catalog_feeds,
    catalog_merge,
    catalog_reports,
    catalog_retrieval,
    catalog_stream,
)
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
