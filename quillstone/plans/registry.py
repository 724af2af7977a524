"""Every query by name, and the SQL that checks it."""

from __future__ import annotations

from quillstone.plans import documents, experiments, relational, retrieval

FLAGSHIP = "hybrid_rrf"
QUERIES = {**retrieval.QUERIES, **relational.QUERIES, **documents.QUERIES, **experiments.QUERIES}
ORACLE_SQL = {**retrieval.ORACLE_SQL, **relational.ORACLE_SQL, **documents.ORACLE_SQL}
