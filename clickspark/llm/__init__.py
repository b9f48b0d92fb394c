"""Operators for preparing training text: scoring, fingerprints, deduplication, tokens, packing.

Nothing else in the library imports this subpackage.
"""
