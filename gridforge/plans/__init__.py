"""Plans of the engine; importing it registers the queries of all its modules."""

from . import contract_queries, model_queries, queries, report_queries

__all__ = ["contract_queries", "model_queries", "queries", "report_queries"]
