"""All registered queries."""

from vanewatch.plans import (  # noqa: F401
    q_ingest,
    q_models,
    q_reports,
    q_rows,
    q_serving,
    q_streams,
)
from vanewatch.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
