"""Operators on training data: text, pages and embeddings."""
