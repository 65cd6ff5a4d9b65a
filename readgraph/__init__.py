"""Long-read overlap graphs on Spark."""
