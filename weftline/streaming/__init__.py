"""Structured Streaming uses of the engine's operators."""
