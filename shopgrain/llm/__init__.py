"""Operators for training-data pipelines over ``documents``, ``embeddings``, ``pages`` and ``benchmark``."""
