"""Registered queries over the driver tables, each beside the SQL that gives the same rows."""

from . import blocking_queries, inventory_queries, matching_queries, more_queries

QUERIES: dict = blocking_queries.QUERIES | matching_queries.QUERIES | more_queries.QUERIES | inventory_queries.QUERIES
ORACLES: dict[str, str] = blocking_queries.ORACLES | matching_queries.ORACLES | more_queries.ORACLES | inventory_queries.ORACLES
