"""Operators on intervals, series and candidates."""
