"""tessera: a PySpark-native engine for typed, evidence-carrying analytics."""
