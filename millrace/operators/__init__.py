"""Relational, window and state operators over batch DataFrames; the folds also run on streams."""
