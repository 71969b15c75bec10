"""Operators of a training-data pipeline: one module per operator, and their registered queries."""
