"""Errors that a query's text or its tables can cause."""


class QueryError(ValueError):
    """The statement isn't in the dialect, or doesn't fit the tables it names."""
