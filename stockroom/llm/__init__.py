"""Operators and queries for preparing language-model training data at scale.

Nothing else in the library imports this subpackage. Every operator is a
Spark job over a DataFrame; ``queries.py`` holds the registered queries and
their SQL twins.
"""
