"""Builds one resource: typed values, relations, and its RDF or update text."""

from __future__ import annotations

import uuid

from .sources.rdf import Term, _turtle_term, literal, to_jsonld, to_turtle
from .vocab import DEFAULT_GRAPH, RDF, XSD


class Resource:
    def __init__(self, iri: str | None = None):
        self.iri = iri or f"urn:bnode:{uuid.uuid4()}"
        self.values: dict[str, list[Term]] = {}
        self.related: list[Resource] = []

    def _term(self, value) -> Term:
        if isinstance(value, Resource):
            self.related.append(value)
            return "iri", value.iri, None
        if isinstance(value, bool):
            return literal(str(value).lower(), XSD + "boolean")
        if isinstance(value, int):
            return literal(str(value), XSD + "integer")
        if isinstance(value, float):
            return literal(repr(value), XSD + "double")
        if hasattr(value, "isoformat"):
            return literal(value.isoformat(), XSD + ("dateTime" if hasattr(value, "hour") else "date"))
        if isinstance(value, tuple):
            return literal(value[0], lang=value[1])
        return literal(str(value))

    def set(self, prop: str, value) -> Resource:
        self.values[prop] = [self._term(value)]
        return self

    def add(self, prop: str, value) -> Resource:
        self.values.setdefault(prop, []).append(self._term(value))
        return self

    def relate(self, prop: str, iri: str) -> Resource:
        self.values.setdefault(prop, []).append(("iri", iri, None))
        return self

    def a(self, cls: str) -> Resource:
        return self.relate(RDF + "type", cls)

    def rows(self, graph: str = DEFAULT_GRAPH) -> list:
        out = [(graph, self.iri, p, o) for p, os in self.values.items() for o in os]
        for r in self.related:
            out += r.rows(graph)
        return out

    def turtle(self) -> str:
        return to_turtle(self.rows())

    def jsonld(self) -> str:
        return to_jsonld(self.rows())

    def update(self, graph: str | None = None) -> str:
        """An INSERT DATA that stores the resource."""
        body = "\n".join(f"{_turtle_term('iri', s, None)} {_turtle_term('iri', p, None)} {_turtle_term(*o)} ." for _, s, p, o in self.rows())
        return f"INSERT DATA {{ GRAPH <{graph}> {{\n{body}\n}} }}" if graph else f"INSERT DATA {{\n{body}\n}}"
