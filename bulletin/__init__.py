"""A PySpark-native engine for semi-structured announcement text."""
