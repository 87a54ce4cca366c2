"""Spark-native curve-network analysis of point clouds, and corpus operators."""
