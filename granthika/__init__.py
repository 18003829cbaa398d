"""granthika: passage-retrieval analytics and corpus preparation as Spark DataFrame jobs."""
