"""Operators: DataFrame to DataFrame, usable with ``df.transform``."""
