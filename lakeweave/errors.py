"""Errors that a query's author caused."""


class QueryError(Exception):
    """The query can't be parsed, resolved or planned."""
