"""Lineament analytics as Spark dataflows."""
