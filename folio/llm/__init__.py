"""Operators for preparing training data; each module holds one operator and the query that applies it."""
