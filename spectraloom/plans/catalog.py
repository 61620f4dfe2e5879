"""All registered queries and their SQL."""

from __future__ import annotations

from spectraloom.plans import relational, signals, learning  # noqa: F401  (importing registers)
from spectraloom.plans.relational import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
