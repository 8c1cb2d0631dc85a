"""Registered plans over the driver's tables."""
