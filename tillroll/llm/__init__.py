"""Operators of a training-data pipeline over ``documents``, ``pages``, ``embeddings`` and ``conversations``.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
