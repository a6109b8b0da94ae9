"""Strategy validation on Spark."""
