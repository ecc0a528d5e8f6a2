"""Operators for large text corpora; their registered queries are in ``queries``."""
