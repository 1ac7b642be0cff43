"""umbra: a PySpark engine for privacy-preserving text processing over tables of documents."""

__version__ = "0.1.0"
