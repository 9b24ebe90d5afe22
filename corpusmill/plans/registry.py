"""All registered queries of the library proper, by name, with the SQL that must give the same rows."""

from __future__ import annotations

from . import base, details, evaluation, lifecycle, retrieval, social, sources, sql_functions, state, text  # noqa: F401


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
