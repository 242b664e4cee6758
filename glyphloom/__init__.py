"""Weighted string relations, rewrite rules and text operators on Spark."""
