"""Query text to Spark columns."""
