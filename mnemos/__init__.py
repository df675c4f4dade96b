"""Typed memory-graph analytics as Spark plans."""
