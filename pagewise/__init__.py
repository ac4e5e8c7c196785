"""Pagewise: document processing and analytics on PySpark."""
