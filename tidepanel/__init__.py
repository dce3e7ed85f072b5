"""Belief-panel analytics on Spark: probability series in, panels, states, graphs and scores out."""
