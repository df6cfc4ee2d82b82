"""Structured Streaming over voxel observations."""
