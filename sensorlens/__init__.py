"""Spark-native analytics for security-sensor telemetry."""
