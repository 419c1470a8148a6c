"""A PySpark-native engine for structural-variant call sets."""
