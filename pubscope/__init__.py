"""pubscope: a PySpark-native analytics engine for publication registers and text corpora."""

__version__ = "0.1.0"
