"""Operators for preparing language-model training data at cluster scale.

Nothing outside this subpackage imports it; `queries.py` holds the registered queries.
"""
