"""Readers and writers at the boundary of the engine."""
