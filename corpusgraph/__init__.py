"""corpusgraph: a PySpark-native analytics engine for versioned technical corpora."""

__version__ = "0.1.0"
