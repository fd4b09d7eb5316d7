"""Memory-log analytics on Spark."""
