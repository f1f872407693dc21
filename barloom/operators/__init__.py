"""Operators over bar tables."""
