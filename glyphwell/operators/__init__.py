"""Operators over word, line, part and report tables."""
