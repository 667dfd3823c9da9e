"""Operators for large text corpora (training-data preparation).

Nothing outside this subpackage imports it.  Each module holds one operator
with a general DataFrame-in, DataFrame-out interface; `queries` holds the thin
`opN_*` queries and their SQL.
"""
