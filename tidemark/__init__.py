"""Detection error analysis and corpus preparation on Spark."""
