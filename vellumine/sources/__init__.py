"""Readers and normalisers of document-service output."""
