"""Operators for training data; nothing else in corvine imports this subpackage."""
