"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; ``queries`` and ``oracle_sql`` in
``llm.catalog`` are added to the driver contract only if it can be imported.
"""
