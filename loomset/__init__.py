"""Spark-native analytics over groups of texts that share one meaning."""
