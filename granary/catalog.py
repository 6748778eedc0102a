"""All registered queries of the engine, and the SQL that gives the same rows."""

from __future__ import annotations

from granary.plans import ingestion, knowledge, pictures, quality, retrieval, structure

_REGISTRIES = (quality.query, retrieval.query, structure.query, knowledge.query, ingestion.query, pictures.query)
QUERIES = {k: f for r in _REGISTRIES for k, f in r.queries.items()}
ORACLES = {k: s for r in _REGISTRIES for k, s in r.oracles.items()}
