"""All queries over the given tables, by name."""

from ordina.catalog import metric_queries, model_queries, preprocess_queries, tree_queries  # noqa: F401
from ordina.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
