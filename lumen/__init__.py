"""lumen: a PySpark-native tabular analytics engine."""
