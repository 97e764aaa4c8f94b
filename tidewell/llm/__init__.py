"""Operators on texts for training corpora.  Nothing else in the library imports this."""
