"""Readers that shape tables into the engine's relations."""
