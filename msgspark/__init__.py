"""Message indexing and retrieval as Spark jobs."""
