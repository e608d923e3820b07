"""Spark jobs for ordered signals and subtitle cues kept as tables."""
