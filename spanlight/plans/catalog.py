"""Named queries over the driver's tables, with the SQL each is held against."""

from __future__ import annotations

from . import export_queries, metric_queries, record_queries, table_queries  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES

FLAGSHIP = "metrics_obs_cost_by_model_daily"


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
