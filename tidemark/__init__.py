"""Spark-native loan-mark analytics."""
