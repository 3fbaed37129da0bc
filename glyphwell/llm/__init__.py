"""Operators that prepare a large text corpus for training language models."""
