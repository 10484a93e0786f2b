"""Types, expressions, scalar functions and aggregates."""
