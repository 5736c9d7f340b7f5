"""All event-analytics queries and the SQL that checks them."""

from __future__ import annotations

from . import basic, bursting, changing, composites, emerging, evolving, integrated, nulls, pairwise, plastic, rhythms, signals, streams, structure, testing
from .registry import ORACLE_SQL, QUERIES, run

__all__ = ["ORACLE_SQL", "QUERIES", "basic", "bursting", "changing", "composites", "emerging", "evolving", "integrated", "nulls", "pairwise", "plastic", "rhythms", "run", "signals", "streams", "structure", "testing"]
