"""Ordered operator lists applied to a whole corpus, and what can be said about them up front."""
