"""Table profiling and relationship discovery as Spark DataFrame jobs."""
