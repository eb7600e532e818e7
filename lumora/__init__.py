"""Timeline, material, search and training-data operators as Spark DataFrame jobs."""
