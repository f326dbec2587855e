"""Lookup tables, files and request payloads."""
