"""All queries of the library; importing the modules registers them."""

from . import q_corpus, q_extract, q_ingest, q_records, q_scores, q_search, q_text  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
