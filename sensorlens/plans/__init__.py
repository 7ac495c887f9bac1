"""Whole plans, and the queries over the driver's tables."""
