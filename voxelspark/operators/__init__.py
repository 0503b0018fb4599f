"""DataFrame operators on voxel tables."""
