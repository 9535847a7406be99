"""Operators for preparing training data: each module is one operator with its own interface."""
