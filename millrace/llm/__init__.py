"""Operators for preparing training corpora.

Nothing else in the library imports this package.  Every operator selects the
columns it needs before anything else, so extra columns never clash, and each
docstring states what it makes of nulls, empty texts, ties and empty tables.
"""
