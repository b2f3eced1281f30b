"""Spark-native feature engine for hourly (entity, hour) panels."""
