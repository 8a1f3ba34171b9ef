"""A Spark-native engine for knowledge corpora."""
