"""Queries over the driver's tables and the SQL that checks them."""

from __future__ import annotations

from loomgraph.queries import audit, details, graphs, merging, mutation, searches, texts

QUERIES = searches.QUERIES | mutation.QUERIES | graphs.QUERIES | audit.QUERIES | texts.QUERIES | details.QUERIES | merging.QUERIES
ORACLES = searches.ORACLES | mutation.ORACLES | graphs.ORACLES | audit.ORACLES | texts.ORACLES | details.ORACLES | merging.ORACLES
