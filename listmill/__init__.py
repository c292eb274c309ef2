"""Listing-data engine on PySpark: extraction, normalisation, merge, read path, statistics and streams."""
