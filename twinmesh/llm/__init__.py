"""Operators of training-data pipelines: similar vectors, groups, history dedup, top-N, packing,
mixing, and content scores. Nothing else in twinmesh imports this package."""
