"""Operators over DataFrames: profiles, cleaning, combining, series and charts."""
