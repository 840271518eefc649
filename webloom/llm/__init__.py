"""Operators that prepare text and vectors for training corpora; nothing else in webloom imports this."""
