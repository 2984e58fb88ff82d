"""Window-qualification analytics on Spark."""
