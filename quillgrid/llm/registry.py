"""The queries of this package and the SQL they are compared to."""

from __future__ import annotations

from quillgrid.llm import queries as q
from quillgrid.llm import sql


def queries() -> dict[str, q.Query]:
    return dict(q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
