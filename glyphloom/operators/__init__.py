"""Operators on relations, arc tables and machines."""
