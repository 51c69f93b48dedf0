"""Namespaces."""

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
FN = "http://www.w3.org/2005/xpath-functions#"
#: Namespaces of our own: ontology annotations, functions, full-text search, driver tables.
ONT = "urn:graphloom:ontology#"
GL = "urn:graphloom:functions#"
FTS = "urn:graphloom:fts#"
DATA = "http://data/onto#"
DEFAULT_GRAPH = "urn:graphloom:default-graph"

PREFIXES = {"rdf": RDF, "rdfs": RDFS, "xsd": XSD, "fn": FN, "ont": ONT, "gl": GL, "fts": FTS, "": DATA, "dc": "http://purl.org/dc/elements/1.1/"}

INTEGERS = {XSD + n for n in "integer long int short byte nonNegativeInteger positiveInteger nonPositiveInteger negativeInteger unsignedLong unsignedInt unsignedShort unsignedByte".split()}
