"""Whole plans: the sample builders, the stand-in tables, and the registered queries with their SQL."""
