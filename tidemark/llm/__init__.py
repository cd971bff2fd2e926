"""Operators for training-data pipelines: search, near-duplicates, scans, mixing and packing.

Nothing else in the library imports this subpackage.
"""
