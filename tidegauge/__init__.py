"""Spark-native analytics from telemetry to service-level objectives."""
