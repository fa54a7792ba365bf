"""All queries of the engine, by import of the modules that register them."""

from ravelin.plans import bar_queries, condition_queries, desk_queries, engine_queries, evaluate_queries, record_queries, signal_queries, strategy_queries, stream_queries, upkeep_queries  # noqa: F401
from ravelin.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
