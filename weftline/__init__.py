"""Web-corpus extraction and reconciliation on Spark."""
