"""A PySpark-native source-evidence analytics engine."""
