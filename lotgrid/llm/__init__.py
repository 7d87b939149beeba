"""Operators for training data about language: nothing else in the library imports this package."""
