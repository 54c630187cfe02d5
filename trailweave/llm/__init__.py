"""Operators for preparing training text at scale.

Nothing outside this subpackage and ``corpus_pipeline.py`` imports it; the
entry module adds its queries only when it is present.
"""
