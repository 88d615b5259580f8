"""Graph, retrieval, rule and corpus analytics as plain PySpark jobs."""
