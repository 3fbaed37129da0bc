"""Queries over the tables of a corpus, each with an independent statement in SQL."""
