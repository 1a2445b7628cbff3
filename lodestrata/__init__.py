"""Spark-native code-graph, text-compaction and usage-metrics analytics."""
