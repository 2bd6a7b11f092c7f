"""Operators for preparing language-model training data, one module each.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
