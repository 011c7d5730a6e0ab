"""Whole questions and the registered queries."""
