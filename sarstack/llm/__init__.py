"""Operators for large training-data pipelines.

Nothing else in ``sarstack`` imports this subpackage; it may be removed whole.
Each module holds one operator with a general interface and the thin query
``opN_*`` that applies it to a whole table.
"""
