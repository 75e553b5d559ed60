"""Loops over time, and cells that arrive as a stream."""
