"""A Spark-native engine for large collections of dense vectors."""
