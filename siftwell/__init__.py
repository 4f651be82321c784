"""siftwell: a Spark-native engine for searching and analysing text and source collections."""

__version__ = "0.1.0"
