"""Named queries and the DuckDB SQL that gives the same rows."""

from textloom.plans import round_trips  # noqa: F401 (registers its queries)
from textloom.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
