"""Calibrated, typed decisions over data, as DataFrame operations."""
