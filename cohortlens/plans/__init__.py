"""Whole queries and runs composed from the operators."""
