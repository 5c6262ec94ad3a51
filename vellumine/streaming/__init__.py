"""Selectors over streams."""
