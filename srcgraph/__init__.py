"""A PySpark-native code analytics engine."""

VERSION = "0.2.0"
