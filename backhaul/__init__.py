"""Returns and reverse-logistics analytics on Spark."""
