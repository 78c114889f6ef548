"""Spark-native corpus building: discovery, extraction, allocation, de-duplication, scoring and export."""
