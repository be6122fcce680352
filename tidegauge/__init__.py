"""Spark-native telemetry analytics: composable DataFrame transforms over samples, counters and process snapshots."""

__version__ = "0.1.0"
