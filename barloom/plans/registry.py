"""All queries of bar analytics and the SQL that checks them."""

from __future__ import annotations

from . import audits, board, files, indicators, machines, search, series  # noqa: F401
from .base import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
