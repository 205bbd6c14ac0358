"""Geohazard analytics as Spark DataFrame transformations."""
