"""Operators over revisions and hits."""
