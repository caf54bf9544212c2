"""Operators over DataFrames; each takes and returns DataFrames and plans lazily unless it says otherwise."""
