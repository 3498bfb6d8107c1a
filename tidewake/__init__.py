"""Vessel-track quality, stop detection and laytime analytics as Spark DataFrame operators."""
