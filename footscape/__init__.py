"""Pedestrian-accessibility analytics as Spark DataFrame operators."""

__all__ = ["functions", "operators", "params", "plans", "schemas", "sources", "streaming"]
