"""Saving and loading meshes and fields."""
