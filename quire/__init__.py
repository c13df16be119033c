"""Spark-native analytics for libraries of versioned, block-structured documents."""
