"""A Spark-native engine for RDF-star graphs with embedded vectors: graph patterns as DataFrame operations."""
