"""Registered queries and their oracle SQL."""

from . import decisions, embedded, exploration, ingest, more, pages, relational, rules, scores, sourcing, texts
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "decisions", "embedded", "exploration", "ingest", "more", "pages", "relational", "rules", "scores", "sourcing", "texts"]
