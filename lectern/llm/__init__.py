"""Operators for preparing training data from large collections of text, pages and vectors."""
