"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; deleting it (with
``corpus_pipeline.py`` and ``tests/llm``) leaves the rest working.
"""
