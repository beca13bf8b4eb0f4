"""tunewright: Spark-native tabular preparation, tuning and trial analytics."""

__version__ = "0.1.0"
