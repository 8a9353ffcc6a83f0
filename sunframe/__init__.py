"""Solar-energy analytics as Spark DataFrame jobs."""
