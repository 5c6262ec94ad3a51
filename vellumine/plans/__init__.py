"""Selector language and configured queries, compiled to plans."""
