"""Readers: model documents and data files."""
