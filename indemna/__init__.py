"""Contract-terms analytics on Spark: temporal graph, screening, adjudication and retrieval."""
