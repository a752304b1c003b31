"""Registered queries of the library's own operators and the SQL they are held against."""

from __future__ import annotations

from . import corpus, enrichment, entities, network, series
from .base import QUERIES, SQL

__all__ = ["FLAGSHIP", "QUERIES", "SQL", "corpus", "enrichment", "entities", "network", "series"]

FLAGSHIP = "story_map"
