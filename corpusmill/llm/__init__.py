"""Operators for preparing large language-model training corpora.

Nothing outside this folder, its tests and ``corpus_pipeline.py`` imports it.
"""
