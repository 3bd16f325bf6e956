"""Spark-native analytics over voxel tables, label images and graphs."""
