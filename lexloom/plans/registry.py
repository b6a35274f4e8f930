"""Every query by name and the SQL of those that SQL can express."""

from __future__ import annotations

from lexloom.plans import catalog, oracle, stages

QUERIES = {name: catalog.query(name, build) for name, build in (catalog.CATALOG | stages.QUERIES).items()}
ORACLE_SQL = oracle.ORACLE_SQL | stages.ORACLE_SQL
