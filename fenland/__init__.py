"""Regional open-data analytics as Spark DataFrame jobs."""
