"""Operators: tables in, a table out."""
