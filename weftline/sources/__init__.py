"""Readers and adapters that bring inputs to the engine's record schema."""
