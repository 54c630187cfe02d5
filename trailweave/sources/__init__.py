"""Readers of graph files, graphs from tables, and the sinks."""
