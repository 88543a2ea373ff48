"""Operators for large-scale training-data pipelines over a ``documents`` style table.

Every module is one operator; ``queries`` holds the thin contract queries.  Nothing
outside this folder imports it.
"""
