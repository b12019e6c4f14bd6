"""Find abnormal members of a fleet from their metrics, on Spark."""
