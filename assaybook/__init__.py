"""assaybook — order-result pricing expressed as Spark DataFrame plans.

Layers:
  sources/    table loading (test fixtures, JDBC extract), fact store, sinks, audit
  functions/  column -> column helpers (collation-aware text, code rules)
  operators/  DataFrame -> DataFrame building blocks (filters, joins, as-of, flags, diff)
  plans/      the shipped queries: fact, views, reports, legacy report, quality checks
  streaming/  intentionally empty (nightly batch only)
"""

__all__ = ["__version__"]
__version__ = "0.1.0"
