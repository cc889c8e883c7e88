"""Spark-native engine for traceable evidence mining over document collections."""
