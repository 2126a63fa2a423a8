"""Operators for building training corpora out of raw tables and texts."""
