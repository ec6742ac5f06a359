"""Spark-native analytics of what changed between two snapshots, and the parts of a training-data pipeline."""
