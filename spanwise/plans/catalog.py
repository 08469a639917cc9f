"""All registered queries and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from . import aggregate_queries, arrangement_queries, bridge_queries, candidate_queries, composite_queries, expression_queries, gap_queries, interval_queries, json_queries, lattice_queries, midi_queries, note_rule_queries, phrase_queries, ragged_queries, relational_queries, run_report_queries, sequence_queries, stem_queries  # noqa: F401
from .registry import REGISTRY

QUERIES = REGISTRY.queries
ORACLES = REGISTRY.sql
