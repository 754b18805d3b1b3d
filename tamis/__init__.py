"""Detection analytics as Spark jobs."""
