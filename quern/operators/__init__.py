"""Operators on DataFrames that Spark SQL has no syntax for."""
