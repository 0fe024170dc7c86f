"""Operators for large-scale training-data preparation.

Nothing else in the package imports this subpackage; its queries are collected
by :mod:`plumbline.llm.queries`.
"""
