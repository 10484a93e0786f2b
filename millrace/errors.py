"""Errors that name what was wrong with a query before anything runs."""


class QueryError(ValueError):
    """A query, graph or specification that is not supported or not valid."""


class UnsupportedError(QueryError):
    """A construct outside the language; the message names it."""


class TypeMismatch(QueryError):
    """An expression whose operand types do not fit."""


class UnknownName(QueryError):
    """A table, column, function or aggregate that does not exist."""


class RevisionConflict(RuntimeError):
    """A reference table changed since the revision that a mutation expected."""
