"""Supplier-catalogue analytics expressed as Spark DataFrame operators."""
