"""Trailmill: trajectory, trail-network and event analytics as Spark DataFrame operators."""
