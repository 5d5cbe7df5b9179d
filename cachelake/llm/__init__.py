"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
