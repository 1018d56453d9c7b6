"""Every query of the library by name, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from textloom.plans.queries import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
