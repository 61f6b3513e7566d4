"""All registered queries."""

from tonearm.queries import browse, documents, histories, matches, merging, scalars, scores, sounds, storage, terms, vectors  # noqa: F401
from tonearm.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
