"""Spatial trace graphs as Spark tables: joins, components, paths, repair, review, voxels."""
