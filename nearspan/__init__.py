"""Spark-native vector similarity joins, their monitoring and rebalancing."""
