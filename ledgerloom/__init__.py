"""A PySpark-native finance analytics engine (see README.md)."""
