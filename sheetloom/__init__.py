"""sheetloom: a PySpark-native engine that turns technical documents into a
structured, citable corpus and answers questions over it."""

__version__ = "0.1.0"
