"""Web-corpus cleaning, link ranking, indexing and search as Spark jobs."""
