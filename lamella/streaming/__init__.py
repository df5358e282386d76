"""Packing with bounded memory, and stateless operators on unbounded streams."""
