"""Operators that turn a text corpus into training data."""
