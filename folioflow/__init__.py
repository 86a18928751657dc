"""Document-processing operators for Spark."""
