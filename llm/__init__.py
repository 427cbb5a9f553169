"""Operators for preparing training data: packing, mixing, counting, scoring, search and deduplication.

Nothing outside this folder imports it.
"""
