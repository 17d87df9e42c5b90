"""Operators for training-text preparation, each a Spark job over a table of documents."""
