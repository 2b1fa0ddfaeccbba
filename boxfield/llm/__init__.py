"""Operators for preparing text corpora at scale.

Nothing outside this folder imports it; see queries.py for the registered queries.
"""
