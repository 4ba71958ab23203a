"""A PySpark-native document-analytics engine."""
