"""Operators on text and near-copies for training data; nothing else in the library imports them."""
