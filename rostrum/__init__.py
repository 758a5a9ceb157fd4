"""Spark-native analytics for versioned speech transcripts and their registry."""
