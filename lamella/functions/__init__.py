"""Expressions over nested columns."""
