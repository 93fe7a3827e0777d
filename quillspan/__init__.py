"""quillspan: a PySpark-native analytics engine for series, text corpora and traces."""

__version__ = "0.1.0"
