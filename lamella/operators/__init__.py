"""Operators on frames of a hierarchy."""
