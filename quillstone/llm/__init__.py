"""Operators for preparing training text: filters, de-duplication, scans, token counts and packing.

Nothing outside this folder and ``corpus_pipeline.py`` imports it, so it can be removed as a whole.
"""
