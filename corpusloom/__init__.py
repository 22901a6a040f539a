"""Spark-native content-freshness and review-evidence analytics."""
