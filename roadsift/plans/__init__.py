"""Composite data products and whole runs."""
