"""Catalog and market analytics as Spark DataFrame operators."""
