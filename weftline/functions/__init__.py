"""Scalar building blocks: expressions and plain functions."""
