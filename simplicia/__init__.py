"""Spark-native topological analytics: point clouds, persistence, panels and factor evaluation."""
