"""Operators for training data: vectors, sketches and corpus text."""
