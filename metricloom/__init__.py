"""A PySpark-native engine for benchmark-result and label-quality analysis."""
