"""A PySpark-native engine for graph-shaped facts."""
