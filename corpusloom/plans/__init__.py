"""Registered queries: name -> plan, and name -> the same result in DuckDB SQL."""

from corpusloom.plans import anchors, checks, code, features, freshness, history, ledgers, lifecycle, logs, migration, panels, policy, presentation, programs, publishing, records, review, status, streams, values

FAMILIES = [freshness, features, policy, review, status, history, ledgers, lifecycle, code, programs, anchors, checks, presentation, records, panels, publishing, migration, values, logs, streams]
QUERIES: dict = {name: plan for family in FAMILIES for name, plan in family.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for family in FAMILIES for name, sql in family.ORACLE_SQL.items()}
