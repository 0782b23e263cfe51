"""A Spark-native engine for market-data analytics."""
