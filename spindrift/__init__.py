"""Spindrift: a PySpark-native engine for catalog search, ranking and telemetry analytics."""
