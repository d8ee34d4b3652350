"""trolley — market-basket analytics written as Spark DataFrame / SQL / ML jobs.

Layout:
  sources/    readers: driver test tables, transaction CSVs, catalogs, stored tables, registry
  functions/  column expressions (calendar, rounding, labels) — all JVM-side
  operators/  transforms, derived tables, metrics, rules, segmentation, recommender
  plans/      join helpers (size-checked broadcast), composite reports, the ETL job
  streaming/  Structured Streaming ingest (file source + foreachBatch)
"""

__all__ = ["session", "schemas"]
