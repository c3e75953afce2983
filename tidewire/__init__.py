"""Spark-native analytics over feed-style text: normalise, deduplicate, classify, score, cluster and serve."""
