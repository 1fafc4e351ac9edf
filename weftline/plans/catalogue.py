"""All registered queries and their SQL."""

from __future__ import annotations

from weftline.plans import panel_queries, text_queries


def queries() -> dict:
    return {**panel_queries.QUERIES, **text_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**panel_queries.ORACLES, **text_queries.ORACLES}
