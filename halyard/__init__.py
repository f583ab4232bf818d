"""Trajectory population analytics on Spark."""
