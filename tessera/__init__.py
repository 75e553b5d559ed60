"""Adaptive, multi-resolution grid data on Spark: interval set algebra, meshes, fields and schemes."""
