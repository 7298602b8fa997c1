"""lodestone: Spark-native integrity analytics over files, documents and events."""

__version__ = "0.1.0"
