"""Column functions on per-voxel arrays."""
