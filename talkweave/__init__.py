"""Spark-native analytics for transcript-like text: clean, segment, enrich, search, assemble evidence, measure."""
