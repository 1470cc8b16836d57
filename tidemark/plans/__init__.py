"""Registered queries. Importing the package registers everything."""

from tidemark.plans import views  # noqa: F401  isort: skip
from tidemark.plans import (  # noqa: F401
    q_columns,
    q_index,
    q_history,
    q_resolve,
    q_registry,
    q_extract,
    q_extended,
    q_tables,
    q_streaming,
)
from tidemark.plans.catalog import ORACLES, QUERIES, VIEWS, run

__all__ = ["ORACLES", "QUERIES", "VIEWS", "run"]
