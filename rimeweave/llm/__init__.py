"""Operators for preparing text corpora as training data.

Nothing outside this subpackage imports it; its queries and SQL are in ``queries.py``.
"""
