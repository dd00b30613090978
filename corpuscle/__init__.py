"""corpuscle: a PySpark-native analytics engine for document corpora and teaching packages."""

__version__ = "0.1.0"
