"""Document-collection analytics on Spark."""
