"""Operators that prepare text corpora for training; see ``queries`` for the registry."""
