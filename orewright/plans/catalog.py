"""All queries and their SQL."""

from . import assay_queries, broker_queries, evidence_queries, kept_queries, ledger_queries, reading_queries, varied_queries

MODULES = (ledger_queries, assay_queries, reading_queries, evidence_queries, kept_queries, broker_queries, varied_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
