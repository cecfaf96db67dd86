"""Log analytics as Spark DataFrame jobs."""
