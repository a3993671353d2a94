"""Queries over the shared tables, with the SQL that each is checked against."""

from . import columns, formats, linkage, skew, summaries, texts, vulnerabilities
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "columns", "formats", "linkage", "skew", "summaries", "texts", "vulnerabilities"]
