"""Operators for large-scale training-data pipelines.

Nothing outside this package imports it. Each module holds one operator; the
thin registered queries over the driver's tables are in ``queries``.
"""
