"""Whole workflows and the queries over the driver's tables."""
