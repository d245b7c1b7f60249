"""Spark jobs over particle-mesh series kept as tables."""
