"""Operators of a training-data pipeline. ``QUERIES`` and ``SQL`` hold their registered queries."""
