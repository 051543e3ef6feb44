"""Transaction ingestion and daily summaries on Spark, and operators for large corpora."""
