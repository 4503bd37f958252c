"""All registered queries of the engine and their oracle SQL."""

from mnemora.plans import analytics, details, graph, ingestion, operations, requests, retrieval

_PARTS = (analytics, retrieval, requests, graph, ingestion, operations, details)
QUERIES: dict = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for part in _PARTS for k, v in part.ORACLE_SQL.items()}
