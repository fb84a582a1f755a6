"""Operators for training-data pipelines: mixing, filters, language ID, dedup, BPE, search.

Nothing outside this folder imports it; `queries.py` lists its queries and SQL.
"""
