"""Transaction monitoring on Spark: ingest, detect, score, replay and report."""
