"""Document-layout analytics on Spark."""
