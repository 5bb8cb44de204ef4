"""Relational operators over point clouds, label maps, trajectories and meshes."""
