"""Document and dialogue analytics on Spark."""
