"""Operators over voxel frames: transforms, set algebra, lookups, writes, covers."""
