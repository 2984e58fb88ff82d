"""Registered queries of the window-qualification engine and their SQL."""

from windowmill.plans import flows, records, sql


def queries() -> dict:
    return flows.QUERIES | records.QUERIES


def oracle_sql() -> dict[str, str]:
    return sql.ORACLES | records.ORACLES
