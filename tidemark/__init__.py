"""Cyclic-telemetry analytics and experiment design on Spark DataFrames."""
