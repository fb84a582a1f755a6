"""Conversions of file streams."""
