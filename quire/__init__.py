"""Document analytics on PySpark: documents, pages and lines as DataFrames."""

__version__ = "0.1.0"
