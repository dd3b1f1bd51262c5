"""Errors of the engine."""


class GraphError(Exception):
    """Base of all errors raised here."""


class ParseError(GraphError):
    """Text that is not in its grammar, with the place."""

    def __init__(self, message: str, line: int = 0, column: int = 0, syntax: str = ""):
        super().__init__(f"{syntax + ': ' if syntax else ''}{message}" + (f" (line {line}, column {column})" if line else ""))
        self.message, self.line, self.column, self.syntax = message, line, column, syntax


class QueryError(GraphError):
    """A query that parses but can't be evaluated as written."""


class LiteralError(GraphError):
    """A literal outside the lexical space of its datatype."""


class EndpointError(GraphError):
    """A remote endpoint that failed."""
