"""Operators for preparing training text: ten jobs on documents, pages and embeddings, and the queries that run them."""
