"""Operators over catalogued records; every one returns a lazy DataFrame."""
