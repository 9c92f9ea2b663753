"""twinmesh: a PySpark-native near-duplicate registry and analytics engine."""
