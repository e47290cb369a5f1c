"""Every query of the library, by name, with its SQL for comparison."""

from __future__ import annotations

from quarryline.queries import conversations, documents, operations, retrieval

AREAS = [retrieval.R, documents.R, conversations.R, operations.R]
QUERIES = {name: query for area in AREAS for name, query in area.queries.items()}
ORACLES = {name: sql for area in AREAS for name, sql in area.oracles.items()}
FLAGSHIP = "retrieve"
