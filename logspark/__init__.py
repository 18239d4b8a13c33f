"""A Spark-native engine for service-log analytics."""
