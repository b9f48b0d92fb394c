"""Click-log analytics as Spark jobs."""
