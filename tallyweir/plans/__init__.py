"""Rollup definitions, their compilation to aggregate expressions, and the query dialect."""
