"""A PySpark-native listing catalogue: ingest, resolve, merge, dedupe, publish, query, notify."""
