"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``queries.py`` here registers its
queries and ``__spark_entry__.py`` adds them when the subpackage is present.
"""
