"""Purchase-line analytics as Spark jobs: ingest, price evidence, history, categories, audits."""
