"""Operators for large-scale training-data preparation.

Nothing outside this folder (but corpus_pipeline.py) imports it, so it can be
removed without touching the rest of the library.
"""
