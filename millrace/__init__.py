"""Catalogue analytics on PySpark: reusable DataFrame-to-DataFrame operators."""
