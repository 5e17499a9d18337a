"""Spark-native content reduction: artifacts, lines, cells and layout runs as DataFrame rows."""
