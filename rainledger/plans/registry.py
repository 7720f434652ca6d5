"""All queries of the core with their SQL."""

from __future__ import annotations

from rainledger.plans import article_queries, impact_queries, model_queries, panel_queries, place_queries, record_queries, report_queries

_MODULES = [impact_queries, article_queries, panel_queries, model_queries, place_queries, record_queries, report_queries]

flagship = impact_queries.region_month_weighted


def queries():
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracles():
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
