"""A Spark-native analytics engine for document catalogues: ingestion, merging, deduplication, audits and evaluation."""
