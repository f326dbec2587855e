"""Validation rules: each builds a boolean Column."""
