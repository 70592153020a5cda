"""lexmill: corpus structuring, graph building and retrieval as Spark DataFrame jobs."""
