"""Operators for large text corpora (one module each) and their queries.

Nothing outside this folder imports it; ``queries.py`` is what the entry module
registers, ``/corpus_pipeline.py`` chains five of the operators.
"""
