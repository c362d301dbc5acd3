"""Operators of a training-data pipeline over the tables documents, pages and embeddings.

Nothing else in the package imports this subpackage; it imports nothing else of the package either.
"""
