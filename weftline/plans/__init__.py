"""Queries over the bundled tables, composed from the operators."""
