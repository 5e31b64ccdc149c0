"""Operators on flows."""
