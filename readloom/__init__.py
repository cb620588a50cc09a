"""A Spark-native engine that classifies and re-multiplexes sequencing reads."""
