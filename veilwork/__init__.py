"""Spark-native personal-data detection, redaction and scoring."""
