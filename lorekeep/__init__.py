"""lorekeep: a Spark-native analytics engine for document knowledge bases."""

__version__ = "0.1.0"
