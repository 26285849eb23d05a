"""Registered queries over the star schema's stand-ins."""

from . import cache_queries, corpus_queries, eval_queries, harvest_queries, misc_queries, store_queries, text_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "cache_queries", "corpus_queries", "eval_queries", "harvest_queries", "misc_queries", "store_queries", "text_queries"]
