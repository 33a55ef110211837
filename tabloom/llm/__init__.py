"""Operators for training-data pipelines: ten numbered methods over a table of documents.

Nothing outside this folder imports it. Every operator has a general function and a thin
query `opN_...` in `queries.py` that applies it to the whole `documents` table.
"""
