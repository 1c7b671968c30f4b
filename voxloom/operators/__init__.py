"""Operators over DataFrames: joins, graphs, grids, fields, statistics."""
