"""icuflow: Spark-native analytics over high-frequency event telemetry."""
