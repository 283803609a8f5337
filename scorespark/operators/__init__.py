"""Operators on DataFrames of events, boxes and sequences."""
