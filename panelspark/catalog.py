"""All queries of the engine by name, and their oracle SQL."""

from .plans import backtest_queries, factor_queries, panel_queries, registry, report_queries, series_queries, storage_queries  # noqa: F401  (modules register their queries)

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
