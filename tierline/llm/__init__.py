"""Operators for training-data pipelines: language ID, token counts, quality,
BPE, exact top-k, n-gram joins, license scans, PII, substring dedup and
benchmark decontamination.  Nothing else in the library imports this package.
"""
