"""Training-data operators: deduplication, mixing, scoring, formatting, filtering and extraction.

Nothing outside this folder imports it. `queries.py` registers one query for each operator.
"""
