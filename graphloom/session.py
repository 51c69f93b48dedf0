"""The session: queries, prepared statements and updates over a snapshot."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from .dataset import Dataset
from .errors import ConstraintViolation, QueryFailed, Unsupported
from .ontology import Ontology
from .operators.fts import Analysis
from .parser.ast import Query
from .parser.grammar import Parser
from .plans.lower import Compiler
from .resource import Resource
from .vocab import PREFIXES


@dataclass(frozen=True)
class Options:
    """``anonymous_bnodes``: results show blank nodes as labels, not as IRIs that queries can use."""

    read_only: bool = False
    anonymous_bnodes: bool = False
    strict_syntax: bool = False
    #: How full-text search reads texts and queries.
    analysis: Analysis = Analysis()


class Namespaces:
    """Prefixes: expand, compress, add."""

    def __init__(self, prefixes: dict[str, str] | None = None):
        self.prefixes = PREFIXES | (prefixes or {})

    def add(self, prefix: str, iri: str) -> None:
        self.prefixes[prefix] = iri

    def expand(self, name: str) -> str:
        prefix, colon, local = name.partition(":")
        return self.prefixes[prefix] + local if colon and prefix in self.prefixes else name

    def compress(self, iri: str) -> str:
        best = max((p for p in self.prefixes.items() if iri.startswith(p[1])), key=lambda p: len(p[1]), default=None)
        return f"{best[0]}:{iri[len(best[1]) :]}" if best else iri


@dataclass
class Statement:
    """A parsed query whose ``~name`` parameters are bound before it runs."""

    session: GraphSession
    query: Query
    values: dict = field(default_factory=dict)

    def bind(self, **values) -> Statement:
        return Statement(self.session, self.query, self.values | values)

    def execute(self) -> DataFrame:
        return self.session.compiler(self.values).run(self.query)


class GraphSession:
    def __init__(self, spark: SparkSession, data: Dataset | Ontology, services: dict | None = None, options: Options = Options()):
        self.spark = spark
        data = data if isinstance(data, Dataset) else Dataset(spark, data)
        self.data = replace(data, options=data.options | {"analysis": options.analysis})
        self.services, self.options = services or {}, options
        self.namespaces = Namespaces(self.data.ontology.prefixes)
        self.listeners: list = []
        self.store = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, ontology: Ontology | None = None, services: dict | None = None, options: Options = Options(), version: int | None = None) -> GraphSession:
        """A session over a durable store: what it publishes is there when the path is opened again.

        A new store takes ``ontology``; an old one moves to it if it differs."""
        from .store import Store

        store = Store(spark, path)
        session = cls(spark, store.open(ontology, version), services, options)
        session.store = store
        if not store.versions():
            session.publish(session.data, session.data)
        elif ontology is not None and session.data.ontology.to_json() != ontology.to_json():
            session.evolve(ontology)
        return session

    def index_texts(self) -> None:
        """Stores full-text postings; matches read them from now on, and updates keep them right."""
        from .operators.fts import TextIndex
        from .plans.lower import Scope

        self.data = replace(self.data, index=TextIndex.build(self.compiler(), Scope(), lambda df, label: self.data.write(df, label)[0]))

    def compiler(self, params: dict | None = None) -> Compiler:
        return Compiler(self.data, params, self.services, self.options.anonymous_bnodes)

    def parse(self, text: str) -> Query:
        return Parser(text, self.namespaces.prefixes, strict=self.options.strict_syntax).query()

    def prepare(self, text: str) -> Statement:
        return Statement(self, self.parse(text))

    def query(self, text: str, **params) -> DataFrame:
        return self.prepare(text).bind(**params).execute()

    def ask(self, text: str, **params) -> bool:
        return self.query(text, **params).first()[0] == "true"

    def update(self, *texts: str, **params) -> None:
        """Runs updates in order; the new snapshot is published only if all succeed."""
        from .update import apply

        if self.options.read_only:
            raise QueryFailed("the session is read-only")
        data, before = self.data, self.data
        for text in texts:
            for u in Parser(text, self.namespaces.prefixes, strict=self.options.strict_syntax).updates():
                data = apply(data, u, params, self.services)
        self.publish(before, data)

    def update_resource(self, resource: Resource, graph: str | None = None) -> None:
        self.update(resource.update(graph))

    def batch(self) -> Batch:
        return Batch(self)

    def graph_rows(self, text: str, **params) -> DataFrame:
        """Quads (g, s, p, o) of a DESCRIBE, or of a CONSTRUCT in the default graph."""
        q = self.parse(text)
        if q.form not in ("describe", "construct"):
            raise Unsupported("only DESCRIBE and CONSTRUCT give a graph")
        return self.compiler(params).graph_rows(q)

    def serialize(self, text: str, fmt: str = "turtle", **params) -> str:
        """A graph as a Turtle, TriG or JSON-LD document, or a table as JSON or XML results."""
        from .sources import rdf, results

        if fmt in ("json", "xml"):
            return (results.to_json if fmt == "json" else results.to_xml)(self.query(text, **params))
        writer = {"turtle": rdf.to_turtle, "trig": rdf.to_trig, "json-ld": rdf.to_jsonld}.get(fmt)
        if writer is None:
            raise Unsupported(f"no writer for {fmt}")
        return writer([tuple(r) for r in self.graph_rows(text, **params).collect()])

    def write_results(self, path: str, text: str, fmt: str = "json", **params) -> None:
        """A table as one JSON or XML results document in a folder, written where the rows are."""
        from .sources import results

        results.write(self.query(text, **params), path, fmt)

    def deserialize(self, path: str, graph: str | None = None) -> None:
        """Adds every document under a path or glob; formats go by file name."""
        from .sources.rdf import read_quads

        self.load(read_quads(self.spark, path, graph))

    def export(self, path: str, text: str | None = None) -> None:
        """Writes the data, or a query's graph, as Turtle lines where the rows are."""
        from .sources.rdf import turtle_lines

        turtle_lines(self.graph_rows(text) if text else self.data.quads()).select("value").write.text(path)

    def load(self, quads: DataFrame) -> None:
        """Adds parsed RDF; classes that properties imply are added too."""
        from .update import inserted

        before = self.data
        self.publish(before, inserted(self.data, quads, implicit=True))

    def publish(self, before: Dataset, after: Dataset) -> None:
        if self.store is not None:
            after = self.store.commit(after)
        self.data = after
        for listener in self.listeners:
            listener(before, after)

    def evolve(self, ontology: Ontology) -> list[tuple[str, str]]:
        """Moves to a new ontology, converting stored values whose range changed."""
        from .update import evolved

        changes = self.data.ontology.evolve(ontology)
        self.publish(self.data, evolved(self.data, ontology, changes))
        return changes


class Batch:
    """Updates, resources and documents collected, then published as one snapshot."""

    def __init__(self, session: GraphSession):
        self.session = session
        self.steps: list = []

    def add_update(self, text: str, **params) -> Batch:
        self.steps.append(("update", text, params))
        return self

    def add_resource(self, resource: Resource, graph: str | None = None) -> Batch:
        return self.add_update(resource.update(graph))

    def add_rdf(self, path: str, graph: str | None = None) -> Batch:
        self.steps.append(("rdf", path, graph))
        return self

    def execute(self) -> None:
        from .sources.rdf import read_quads
        from .update import apply, inserted

        s = self.session
        if s.options.read_only:
            raise QueryFailed("the session is read-only")
        data = s.data
        for kind, what, more in self.steps:
            if kind == "rdf":
                data = inserted(data, read_quads(s.spark, what, more), implicit=True)
                continue
            for u in Parser(what, s.namespaces.prefixes, strict=s.options.strict_syntax).updates():
                data = apply(data, u, more, s.services)
        self.steps = []
        s.publish(s.data, data)


__all__ = ["Batch", "GraphSession", "Namespaces", "Options", "Statement", "ConstraintViolation"]
