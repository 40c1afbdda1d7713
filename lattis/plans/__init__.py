"""Registered queries: operators bound to the driver's tables, with DuckDB SQL."""

from lattis.plans import corpus, facts, graph, logs, retrieval, streams, understanding

MODULES = [retrieval, understanding, corpus, graph, logs, facts, streams]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
