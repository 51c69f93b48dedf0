"""Command line: query, update, introspect, export, import and endpoint over mapped tables or a store."""

from __future__ import annotations

import argparse
import threading

from pyspark.sql import SparkSession

from .errors import OntologyMissing
from .ontology import Ontology
from .session import GraphSession
from .sources import tables
from .sources.rdf import read_ontology


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="graphloom")
    p.add_argument("command", choices=("query", "update", "introspect", "export", "import", "endpoint"))
    p.add_argument("text", nargs="?", help="query or update text, or the path to write to or read from")
    p.add_argument("--tables", help="folder of Parquet tables to see as a graph")
    p.add_argument("--store", help="folder of a durable store; updates and imports stay there")
    p.add_argument("--ontology", help="Turtle file or folder with the ontology of a new store")
    p.add_argument("--graph", help="graph that an import adds to")
    p.add_argument("--format", choices=("table", "json", "xml", "turtle", "trig", "json-ld"), default="table")
    p.add_argument("--port", type=int, default=8080, help="of the endpoint")
    a = p.parse_args(argv)
    if bool(a.tables) == bool(a.store):
        p.error("one of --tables and --store is needed")
    if a.command in ("import", "update") and not a.store:
        p.error(f"{a.command} needs --store: tables are not written to")
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    if a.tables:
        session = GraphSession(spark, tables.dataset(spark, a.tables))
    else:
        ontology: Ontology | None = read_ontology(spark, a.ontology) if a.ontology else None
        try:
            session = GraphSession.open(spark, a.store, ontology)
        except OntologyMissing as e:
            p.error(f"{e}: --ontology is needed")
    if a.command == "introspect":
        for c in session.data.ontology.classes.values():
            print("class", session.namespaces.compress(c.iri))
        for d in session.data.ontology.properties.values():
            print("property", session.namespaces.compress(d.iri), session.namespaces.compress(d.domain), session.namespaces.compress(d.range))
    elif a.command == "export":
        session.export(a.text)
    elif a.command == "import":
        session.deserialize(a.text, a.graph)
        print(session.data.quads().count(), "quads")
    elif a.command == "update":
        session.update(a.text)
    elif a.command == "endpoint":
        from .endpoint import Endpoint

        print(Endpoint(session, port=a.port).url)
        threading.Event().wait()
    elif a.format == "table":
        session.query(a.text).show(100, False)
    else:
        print(session.serialize(a.text, a.format))


if __name__ == "__main__":
    main()
