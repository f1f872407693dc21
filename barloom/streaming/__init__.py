"""Bars from event streams."""
