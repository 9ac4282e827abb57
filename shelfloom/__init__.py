"""Catalog-data analytics on Spark."""
