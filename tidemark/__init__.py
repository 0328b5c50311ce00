"""Spark-native forecasting and decision analytics over entity-over-time tables."""
