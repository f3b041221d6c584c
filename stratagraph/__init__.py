"""A Spark-native engine for architecture graphs over source repositories."""
