"""All queries of the engine and their SQL."""

from . import state_queries  # noqa: F401  registers its queries with the catalogue's
from .catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
