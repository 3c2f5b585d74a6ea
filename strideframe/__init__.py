"""Keyed time-series trajectories on Spark: sources, operators, functions, plans and streams."""
