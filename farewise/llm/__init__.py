"""Operators for large-scale training-data pipelines.

Each module holds one operator with a general interface; ``queries`` binds the
operators to the driver's tables.  Nothing outside this folder imports it.
"""
