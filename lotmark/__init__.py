"""Procurement relationship analytics on Spark."""
