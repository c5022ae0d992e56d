"""Scalar functions: the add family, collations, IEEE floats, canonical JSON."""
