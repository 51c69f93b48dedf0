"""Errors a caller can tell apart."""


class GraphError(Exception):
    """Base of all errors of the engine."""


class ParseError(GraphError):
    pass


class TypeMismatch(GraphError):
    pass


class UnknownClass(GraphError):
    pass


class UnknownProperty(GraphError):
    pass


class UnknownGraph(GraphError):
    pass


class ConstraintViolation(GraphError):
    pass


class OntologyError(GraphError):
    pass


class Unsupported(GraphError):
    pass


class QueryFailed(GraphError):
    pass


class OpenFailed(GraphError):
    """A store, or the folder for one, cannot be opened."""


class OntologyMissing(OpenFailed):
    """A new store needs an ontology."""


class NoSpace(GraphError):
    """A folder is full."""


class Conflict(GraphError):
    """Another writer has published the same version of a store."""
