"""Trailweave: k-path detection and graph layout analytics as Spark DataFrame plans."""
