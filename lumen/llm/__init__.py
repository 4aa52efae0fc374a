"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; `queries` registers its queries.
"""
