"""Whole plans, their configuration, and the driver queries."""
