"""Operators on interval tables, cell sets, meshes, fields and schemes."""
