"""Operators over DataFrames: moves, edges, search, trees, rasters, networks, sampling."""
