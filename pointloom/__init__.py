"""Spark-native analytics for large point clouds and the graphs and meshes made from them."""
