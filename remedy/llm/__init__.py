"""Operators of a training-data pipeline: one module per operator.

Nothing else in the library imports this subpackage. Each module holds the operator
with its general interface and the thin ``opN_<name>`` query that applies it to a table.
"""
