"""Small graphs written for the tests."""

from graphloom.ontology import Ontology
from graphloom.session import GraphSession
from graphloom.sources.rdf import parse_turtle, to_frame

PREFIX = """
@prefix ont: <urn:graphloom:ontology#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix t: <urn:t#> .
"""
ONTOLOGY = (
    PREFIX
    + """
<urn:t#> a ont:Namespace ; ont:prefix "t" .
t:Agent a rdfs:Class ; rdfs:subClassOf rdfs:Resource .
t:Person a rdfs:Class ; rdfs:subClassOf t:Agent ; ont:notify true .
t:Team a rdfs:Class ; rdfs:subClassOf t:Agent .
t:called a rdf:Property ; rdfs:domain t:Agent ; rdfs:range xsd:string ; ont:maxCardinality 1 ; rdfs:subPropertyOf rdfs:label ; ont:fulltextIndexed true ; ont:weight 5 .
t:note a rdf:Property ; rdfs:domain t:Agent ; rdfs:range xsd:string ; ont:fulltextIndexed true .
t:age a rdf:Property ; rdfs:domain t:Person ; rdfs:range xsd:integer ; ont:maxCardinality 1 .
t:score a rdf:Property ; rdfs:domain t:Person ; rdfs:range xsd:double .
t:born a rdf:Property ; rdfs:domain t:Person ; rdfs:range xsd:dateTime ; ont:maxCardinality 1 .
t:motto a rdf:Property ; rdfs:domain t:Agent ; rdfs:range rdf:langString .
t:knows a rdf:Property ; rdfs:domain t:Person ; rdfs:range t:Person .
t:friend a rdf:Property ; rdfs:domain t:Person ; rdfs:range t:Person ; rdfs:subPropertyOf t:knows .
t:member a rdf:Property ; rdfs:domain t:Team ; rdfs:range t:Agent .
t:badge a rdf:Property, ont:InverseFunctionalProperty ; rdfs:domain t:Person ; rdfs:range xsd:string .
t:items a rdf:Property ; rdfs:domain t:Agent ; rdfs:range rdf:List .
"""
)
PEOPLE = (
    PREFIX
    + """
<urn:ann> a t:Person ; t:called "Ann" ; t:age 40 ; t:score 1.5, 2.5 ; t:knows <urn:bob> ; t:note "likes green tea" ; t:born "1980-03-04T05:06:07.25+02:00"^^xsd:dateTime .
<urn:bob> a t:Person ; t:called "bob" ; t:age 30 ; t:score 4.0 ; t:friend <urn:cat> ; t:motto "hallo"@de, "hello"@en-GB .
<urn:cat> a t:Person ; t:called "The Cat" ; t:knows <urn:ann> ; t:note "green apples and tea" .
<urn:dan> a t:Person ; t:called "Dan" ; t:age 30 .
<urn:red> a t:Team ; t:called "A Red team" ; t:member <urn:ann>, <urn:dan> ; t:items ( <urn:ann> <urn:bob> ) .
"""
)


def session(spark, data: str = PEOPLE, ontology: str = ONTOLOGY, **options) -> GraphSession:
    s = GraphSession(spark, Ontology.of(*_parts(ontology)), **options)
    if data:
        s.load(to_frame(spark, parse_turtle(data)))
    return s


def _parts(text: str):
    o = Ontology.from_quads(parse_turtle(text))
    return o.classes.values(), o.properties.values(), o.prefixes


def rows(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]
