"""All registered queries of the analytics engine and their oracle SQL."""

from __future__ import annotations

from corpuslens.catalogue import decisions, gaps, models, profile, records, studies, terms, texts, topic_map
from corpuslens.registry import ORACLES, QUERIES

entry = topic_map.answer

__all__ = ["ORACLES", "QUERIES", "decisions", "entry", "gaps", "models", "profile", "records", "studies", "terms", "texts"]
