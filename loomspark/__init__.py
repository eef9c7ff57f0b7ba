"""loomspark: a PySpark-native engine for curating, scoring and evaluating instruction data."""
