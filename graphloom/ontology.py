"""Classes and properties declared in advance, with closures and validation."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from .errors import OntologyError, UnknownClass, UnknownProperty
from .terms import IRI, T, range_type
from .vocab import ONT, RDF, RDFS, XSD


@dataclass(frozen=True)
class ClassDef:
    iri: str
    parents: tuple[str, ...] = ()
    notify: bool = False


@dataclass(frozen=True)
class PropertyDef:
    iri: str
    domain: str
    range: str
    single: bool = False
    parents: tuple[str, ...] = ()
    fulltext: bool = False
    weight: float = 1.0
    unique: bool = False

    @property
    def type(self) -> T:
        return range_type(self.range)


BASE_CLASSES = (ClassDef(RDFS + "Resource"), ClassDef(RDFS + "Class", (RDFS + "Resource",)), ClassDef(RDF + "Property", (RDFS + "Resource",)), ClassDef(RDF + "List", (RDFS + "Resource",)))
BASE_PROPERTIES = (
    PropertyDef(RDF + "type", RDFS + "Resource", RDFS + "Class"),
    PropertyDef(RDFS + "label", RDFS + "Resource", XSD + "string"),
    PropertyDef(RDFS + "comment", RDFS + "Resource", XSD + "string"),
    PropertyDef(RDF + "first", RDF + "List", RDFS + "Resource", single=True),
    PropertyDef(RDF + "rest", RDF + "List", RDF + "List", single=True),
    PropertyDef(RDFS + "subClassOf", RDFS + "Class", RDFS + "Class"),
    PropertyDef(RDFS + "subPropertyOf", RDF + "Property", RDF + "Property"),
    PropertyDef(RDFS + "domain", RDF + "Property", RDFS + "Class", single=True),
    PropertyDef(RDFS + "range", RDF + "Property", RDFS + "Class", single=True),
    PropertyDef(ONT + "maxCardinality", RDF + "Property", XSD + "integer", single=True),
    PropertyDef(ONT + "fulltextIndexed", RDF + "Property", XSD + "boolean", single=True),
    PropertyDef(ONT + "weight", RDF + "Property", XSD + "double", single=True),
    PropertyDef(ONT + "notify", RDFS + "Class", XSD + "boolean", single=True),
    PropertyDef(ONT + "added", RDFS + "Resource", XSD + "dateTime", single=True),
    PropertyDef(ONT + "modified", RDFS + "Resource", XSD + "integer", single=True),
)


#: Classes of the schema's own resources, and the properties that only they have.
SCHEMA_CLASSES = (RDFS + "Class", RDF + "Property")
SCHEMA_PROPERTIES = (RDFS + "subClassOf", RDFS + "subPropertyOf", RDFS + "domain", RDFS + "range", ONT + "maxCardinality", ONT + "fulltextIndexed", ONT + "weight", ONT + "notify")


@dataclass
class Ontology:
    classes: dict[str, ClassDef] = field(default_factory=dict)
    properties: dict[str, PropertyDef] = field(default_factory=dict)
    prefixes: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, classes: Iterable[ClassDef], properties: Iterable[PropertyDef], prefixes: dict[str, str] | None = None) -> Ontology:
        o = cls({c.iri: c for c in (*BASE_CLASSES, *classes)}, {p.iri: p for p in (*BASE_PROPERTIES, *properties)}, dict(prefixes or {}))
        o.validate()
        return o

    def triples(self) -> list[tuple[str, str, str, str]]:
        """The schema as data: (subject, property, kind and text of the object).

        Classes and properties are told as such, not among the resources that the data describes."""
        out = []
        for c in self.classes.values():
            out.append((c.iri, RDF + "type", "iri", RDFS + "Class"))
            out += [(c.iri, RDFS + "subClassOf", "iri", p) for p in c.parents]
            out += [(c.iri, ONT + "notify", "boolean", "true")] if c.notify else []
        for p in self.properties.values():
            out.append((p.iri, RDF + "type", "iri", RDF + "Property"))
            out += [(p.iri, RDFS + "domain", "iri", p.domain), (p.iri, RDFS + "range", "iri", p.range)]
            out += [(p.iri, RDFS + "subPropertyOf", "iri", q) for q in p.parents]
            out += [(p.iri, ONT + "maxCardinality", "integer", "1")] if p.single else []
            out += [(p.iri, ONT + "fulltextIndexed", "boolean", "true"), (p.iri, ONT + "weight", "double", str(float(p.weight)))] if p.fulltext else []
        return out

    def to_json(self) -> str:
        return json.dumps({"classes": [asdict(c) for c in self.classes.values()], "properties": [asdict(p) for p in self.properties.values()], "prefixes": self.prefixes})

    @classmethod
    def from_json(cls, text: str) -> Ontology:
        d = json.loads(text)
        listed = lambda x: {k: tuple(v) if isinstance(v, list) else v for k, v in x.items()}
        return cls.of((ClassDef(**listed(c)) for c in d["classes"]), (PropertyDef(**listed(p)) for p in d["properties"]), d["prefixes"])

    def class_def(self, iri: str) -> ClassDef:
        if iri not in self.classes:
            raise UnknownClass(iri)
        return self.classes[iri]

    def property_def(self, iri: str) -> PropertyDef:
        if iri not in self.properties:
            raise UnknownProperty(iri)
        return self.properties[iri]

    @staticmethod
    def _closure(start: str, parents) -> list[str]:
        out, todo = [], [start]
        while todo:
            x = todo.pop(0)
            if x not in out:
                out.append(x)
                todo += parents(x)
        return out

    def superclasses(self, iri: str) -> list[str]:
        """The class and all above it; every class is a resource."""
        up = self._closure(iri, lambda c: self.classes[c].parents if c in self.classes else ())
        return up if RDFS + "Resource" in up else [*up, RDFS + "Resource"]

    def subclasses(self, iri: str) -> set[str]:
        self.class_def(iri)
        return {c for c in self.classes if iri in self.superclasses(c)}

    def superproperties(self, iri: str) -> list[str]:
        return self._closure(iri, lambda p: self.properties[p].parents if p in self.properties else ())

    def subproperties(self, iri: str) -> set[str]:
        self.property_def(iri)
        return {p for p in self.properties if iri in self.superproperties(p)}

    def validate(self) -> None:
        """Parents and domains exist, no class is its own ancestor, and a
        property's domain lies under its super-property's domain."""
        for c in self.classes.values():
            for p in c.parents:
                if p not in self.classes:
                    raise OntologyError(f"{c.iri}: unknown class {p}")
                if c.iri in self._closure(p, lambda x: self.classes[x].parents if x in self.classes else ()):
                    raise OntologyError(f"{c.iri} is its own ancestor")
        for p in self.properties.values():
            if p.domain not in self.classes:
                raise OntologyError(f"{p.iri}: unknown domain {p.domain}")
            if p.type is IRI and p.range not in self.classes:
                raise OntologyError(f"{p.iri}: unknown range {p.range}")
            for q in p.parents:
                if q not in self.properties:
                    raise OntologyError(f"{p.iri}: unknown property {q}")
                if self.properties[q].domain not in self.superclasses(p.domain):
                    raise OntologyError(f"{p.iri}: its domain is not under that of {q}")

    @classmethod
    def from_quads(cls, quads: Iterable[tuple[str, str, tuple, str | None]]) -> Ontology:
        """From parsed RDF quads (s, p, o, g), o being (kind, lex, lang)."""
        about: dict[str, dict[str, list[str]]] = {}
        for s, p, o, _ in quads:
            about.setdefault(s, {}).setdefault(p, []).append(o[1])
        classes, properties, prefixes = [], [], {}
        for s, d in about.items():
            types = d.get(RDF + "type", [])
            if ONT + "Namespace" in types:
                prefixes[d[ONT + "prefix"][0]] = s
            if RDFS + "Class" in types:
                classes.append(ClassDef(s, tuple(d.get(RDFS + "subClassOf", ())), "true" in d.get(ONT + "notify", ())))
            if RDF + "Property" in types:
                if RDFS + "domain" not in d or RDFS + "range" not in d:
                    raise OntologyError(f"{s}: domain and range are needed")
                most = d.get(ONT + "maxCardinality", [None])[0]
                if most is not None and int(most) == 0:
                    raise OntologyError(f"{s}: cardinality 0")
                properties.append(PropertyDef(s, d[RDFS + "domain"][0], d[RDFS + "range"][0], most == "1", tuple(d.get(RDFS + "subPropertyOf", ())), "true" in d.get(ONT + "fulltextIndexed", ()), float(d.get(ONT + "weight", ["1"])[0]), ONT + "InverseFunctionalProperty" in types))
        return cls.of(classes, properties, prefixes)

    #: Range changes that keep the stored values readable.
    _RANGES = {XSD + "integer", XSD + "double", XSD + "string", XSD + "boolean"}

    def evolve(self, new: Ontology) -> list[tuple[str, str]]:
        """Changes (what, iri) from this ontology to ``new``; refuses those that could lose data's meaning."""
        out = [("add class", c) for c in new.classes.keys() - self.classes.keys()] + [("remove class", c) for c in self.classes.keys() - new.classes.keys()]
        out += [("add property", p) for p in new.properties.keys() - self.properties.keys()] + [("remove property", p) for p in self.properties.keys() - new.properties.keys()]
        for iri in self.classes.keys() & new.classes.keys():
            if set(self.classes[iri].parents) != set(new.classes[iri].parents):
                out.append(("change super-classes", iri))
            if self.classes[iri].notify != new.classes[iri].notify:
                out.append(("change notification", iri))
        for iri in self.properties.keys() & new.properties.keys():
            a, b = self.properties[iri], new.properties[iri]
            if a.domain != b.domain:
                raise OntologyError(f"{iri}: the domain cannot change")
            if b.single and not a.single:
                raise OntologyError(f"{iri}: a cardinality cannot be added")
            if b.unique and not a.unique:
                raise OntologyError(f"{iri}: uniqueness cannot be added")
            if a.range != b.range:
                if not {a.range, b.range} <= self._RANGES:
                    raise OntologyError(f"{iri}: the range cannot change from {a.range} to {b.range}")
                out.append(("change range", iri))
            if a.single and not b.single:
                out.append(("remove cardinality", iri))
            if a.unique and not b.unique:
                out.append(("remove uniqueness", iri))
            if set(a.parents) != set(b.parents):
                out.append(("change super-properties", iri))
            if (a.fulltext, a.weight) != (b.fulltext, b.weight):
                out.append(("change full-text index", iri))
        return sorted(out)
