"""Operators on text corpora and record linkage for training data; nothing else in the library imports this package."""

QUERY_MODULES = ["sonarium.llm.queries"]
