"""Text analytics and ranked retrieval on Spark."""
