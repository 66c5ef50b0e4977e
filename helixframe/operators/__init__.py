"""Relational operators of the codecs."""
