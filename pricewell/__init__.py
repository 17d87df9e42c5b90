"""Station price analytics as Spark DataFrame jobs."""
