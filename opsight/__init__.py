"""opsight: operational-health analytics as Spark DataFrame plans.

Sub-packages:
  sources    table loading, test-table adapters, sinks (partitioned write, upsert, csv, retention)
  functions  Column-level helpers (ladders, windows, logit, Holt fold, OLS, formats, Luhn, cosine)
  operators  user-level jobs: health, anomaly, leading indicators, enterprise indicators, KPIs, git stats
  plans      the registered query set and its DuckDB oracle statements
  streaming  Structured Streaming twins of the batch operators
"""

__all__ = ["session"]
