"""Tracewright: a Spark-native engine for corpora of tool-using agent trajectories."""
