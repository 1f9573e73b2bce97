"""lumenarc: a PySpark-native engine for personal media archives."""
