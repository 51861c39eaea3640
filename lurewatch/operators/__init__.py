"""Operators on DataFrames: campaigns, graph, pivots, forensics, learning, cases."""
