"""Operators that a large training-data pipeline needs.

The rest of the library doesn't import this subpackage.
"""
