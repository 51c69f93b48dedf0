"""Updates as snapshots: propagation, constraints, graphs, ontology changes, notification."""

import pytest
from graphs import ONTOLOGY, PREFIX, _parts, rows, session

from graphloom.errors import ConstraintViolation, OntologyError, ParseError, QueryFailed, UnknownGraph, UnknownProperty
from graphloom.ontology import ClassDef, Ontology, PropertyDef
from graphloom.resource import Resource
from graphloom.session import Options
from graphloom.streaming.notifier import Notifier
from graphloom.vocab import RDFS, XSD


def one(s, text):
    return sorted(rows(s.query(text)), key=repr)


@pytest.fixture
def s(spark):
    return session(spark, PREFIX + '<urn:a> a t:Person ; t:called "A" ; t:age 1 ; t:friend <urn:b> . <urn:b> a t:Person ; t:called "B" .')


def test_supertypes_and_superproperties_propagate(s):
    assert one(s, "SELECT ?x { ?x a t:Agent }") == [("urn:a",), ("urn:b",)]
    assert one(s, "SELECT ?x ?y { ?x t:knows ?y }") == [("urn:a", "urn:b")]
    s.update("INSERT DATA { <urn:c> a t:Person ; t:called 'C' ; t:friend <urn:a> }")
    assert one(s, "SELECT ?y { <urn:c> t:knows ?y }") == [("urn:a",)]
    assert one(s, "SELECT ?l { <urn:c> rdfs:label ?l }") == [("C",)]


def test_cardinality(s):
    s.update("INSERT DATA { <urn:a> t:age 1 }")  # the same value again changes nothing
    with pytest.raises(ConstraintViolation):
        s.update("INSERT DATA { <urn:a> t:age 2 }")
    assert one(s, "SELECT ?n { <urn:a> t:age ?n }") == [(1,)]
    s.update("INSERT OR REPLACE { <urn:a> t:age 2 }")
    assert one(s, "SELECT ?n { <urn:a> t:age ?n }") == [(2,)]
    s.update("INSERT DATA { <urn:a> t:age NULL }")
    assert one(s, "SELECT ?n { <urn:a> t:age ?n }") == []


def test_unique_values_and_domains(s):
    s.update("INSERT DATA { <urn:a> t:badge '1' }")
    with pytest.raises(ConstraintViolation):
        s.update("INSERT DATA { <urn:b> t:badge '1' }")
    with pytest.raises(ConstraintViolation):
        s.update("INSERT DATA { <urn:new> t:age 3 }")
    with pytest.raises(UnknownProperty):
        s.update("INSERT DATA { <urn:a> t:nothing 3 }")


def test_several_updates_are_one_transaction(s):
    with pytest.raises(ConstraintViolation):
        s.update("INSERT DATA { <urn:a> t:note 'x' } ; INSERT DATA { <urn:a> t:age 9 }")
    assert one(s, "SELECT ?n { ?x t:note ?n }") == []
    s.update("INSERT DATA { <urn:a> t:note 'x' } ; INSERT SILENT { <urn:a> t:age 9 } WHERE { }")
    assert one(s, "SELECT ?n { ?x t:note ?n }") == [("x",)]


def test_modify_reads_once_then_deletes_and_inserts(s):
    s.update("DELETE { ?x t:called ?n } INSERT { ?x t:called ?m } WHERE { ?x a t:Person ; t:called ?n BIND (CONCAT(?n, ?n) AS ?m) }")
    assert one(s, "SELECT ?n { ?x t:called ?n }") == [("AA",), ("BB",)]
    s.update("DELETE WHERE { ?x t:age ?n }")
    assert one(s, "SELECT ?n { ?x t:age ?n }") == []
    s.update("DELETE DATA { <urn:a> t:called 'other' }")
    assert len(one(s, "SELECT ?n { ?x t:called ?n }")) == 2


def test_losing_a_type_takes_its_values(s):
    s.update("DELETE DATA { <urn:a> a t:Person }")
    assert one(s, "SELECT ?x { ?x a t:Person }") == [("urn:b",)]
    assert one(s, "SELECT ?n { <urn:a> t:age ?n }") == []
    assert one(s, "SELECT ?n { <urn:a> t:called ?n }") == [("A",)]
    s.update("DELETE DATA { <urn:a> a rdfs:Resource }")
    assert one(s, "SELECT ?p { <urn:a> ?p ?o }") == []


def test_graph_management(s):
    s.update("CREATE GRAPH <urn:g>")
    with pytest.raises(UnknownGraph):
        s.update("CREATE GRAPH <urn:g>")
    s.update("INSERT DATA { GRAPH <urn:g> { <urn:x> a t:Person } } ; COPY <urn:g> TO <urn:h> ; MOVE <urn:g> TO <urn:i> ; ADD <urn:h> TO <urn:h>")
    assert one(s, "SELECT ?g { GRAPH ?g { <urn:x> a t:Person } }") == [("urn:h",), ("urn:i",)]
    s.update("CLEAR GRAPH <urn:h> ; DROP GRAPH <urn:i>")
    assert one(s, "SELECT ?g { GRAPH ?g { ?x a t:Person } }") == []
    with pytest.raises(UnknownGraph):
        s.update("DROP GRAPH <urn:none>")
    s.update("DROP SILENT GRAPH <urn:none> ; CLEAR ALL")
    assert one(s, "SELECT ?x { ?x a rdfs:Resource }") == []


def test_update_constraints_and_options(spark, s):
    with pytest.raises(ConstraintViolation):
        s.update("CONSTRAINT GRAPH <urn:only> INSERT DATA { <urn:z> a t:Person }")
    s.update("WITH <urn:g> INSERT { <urn:z> a t:Person } WHERE { }")
    assert one(s, "SELECT ?x { GRAPH <urn:g> { ?x a t:Person } }") == [("urn:z",)]
    with pytest.raises(QueryFailed):
        session(spark, "", options=Options(read_only=True)).update("INSERT DATA { <urn:z> a t:Person }")
    with pytest.raises(ParseError):
        s.update("INSERT DATA { ?x a t:Person }")


def test_load(spark, s, tmp_path):
    (tmp_path / "x.ttl").write_text(PREFIX + '<urn:f> t:age 5 . [ t:called "nameless" ] .')
    s.update(f"LOAD <file://{tmp_path}/x.ttl> INTO GRAPH <urn:file>")
    assert one(s, "SELECT ?x { GRAPH <urn:file> { ?x a t:Person ; t:age 5 } }") == [("urn:f",)]
    assert [isinstance(x, str) and x.startswith("urn:bnode:") for (x,) in one(s, "SELECT ?x { ?x t:called 'nameless' }")] == [True]


def test_resources(s):
    r = Resource("urn:r").a("urn:t#Person").set("urn:t#called", "Rob \"R\"").add("urn:t#score", 1.5).add("urn:t#motto", ("hi", "en")).set("urn:t#age", 8)
    r.add("urn:t#knows", Resource("urn:q").a("urn:t#Person"))
    s.update(r.update("urn:g"))
    assert one(s, "SELECT ?n ?s ?q { GRAPH <urn:g> { <urn:r> t:called ?n ; t:score ?s ; t:knows ?q } }") == [('Rob "R"', 1.5, "urn:q")]
    assert "urn:r" in r.turtle() and '"@language": "en"' in r.jsonld()


def test_notifier(s):
    seen = []
    n = Notifier(s, lambda df: seen.append(sorted(rows(df.select("event", "resource")))))
    s.update("INSERT DATA { <urn:n> a t:Person ; t:called 'N' . <urn:team> a t:Team }")
    s.update("DELETE DATA { <urn:n> a rdfs:Resource } ; INSERT OR REPLACE { <urn:a> t:age 3 }")
    with pytest.raises(ConstraintViolation):
        s.update("INSERT DATA { <urn:a> t:age 4 }")
    assert seen == [[("CREATE", "urn:n")], [("DELETE", "urn:n"), ("UPDATE", "urn:a")]]
    n.close()
    s.update("INSERT DATA { <urn:n2> a t:Person }")
    assert len(seen) == 2


def changed(**more) -> Ontology:
    classes, properties, prefixes = _parts(ONTOLOGY)
    ps = {p.iri: p for p in properties}
    for k, v in more.items():
        old = ps["urn:t#" + k]
        ps["urn:t#" + k] = PropertyDef(**{f: v.get(f, getattr(old, f)) for f in old.__dataclass_fields__})
    return Ontology.of(classes, ps.values(), prefixes)


def test_ontology_evolution(s):
    changes = s.evolve(changed(age={"range": XSD + "double"}))
    assert ("change range", "urn:t#age") in changes
    assert one(s, "SELECT ?n { ?x t:age ?n }") == [(1.0,)]
    s.evolve(changed(age={"range": XSD + "string", "single": False}))
    assert one(s, "SELECT ?n { ?x t:age ?n }") == [("1.0",)]
    for bad in ({"score": {"single": True}}, {"note": {"unique": True}}, {"score": {"domain": "urn:t#Agent"}}, {"born": {"range": XSD + "integer"}}):
        with pytest.raises(OntologyError):
            s.evolve(changed(**{"age": {"range": XSD + "string", "single": False}} | bad))


def test_ontology_errors():
    ok = ClassDef("urn:C", (RDFS + "Resource",))
    for classes, properties in (
        ([ClassDef("urn:A", ("urn:B",)), ClassDef("urn:B", ("urn:A",))], []),
        ([ClassDef("urn:A", ("urn:none",))], []),
        ([ok], [PropertyDef("urn:p", "urn:none", XSD + "string")]),
        ([ok], [PropertyDef("urn:p", "urn:C", "urn:none")]),
        ([ok, ClassDef("urn:D")], [PropertyDef("urn:p", "urn:C", XSD + "string"), PropertyDef("urn:q", "urn:D", XSD + "string", parents=("urn:p",))]),
    ):
        with pytest.raises(OntologyError):
            Ontology.of(classes, properties)


def test_change_log_stream(spark, tmp_path):
    from graphloom.streaming.notifier import stream

    schema = "event string, graph string, resource string, at timestamp"
    log = spark.createDataFrame([("CREATE", "urn:g", "urn:a", None), ("noise", "urn:g", "urn:b", None), ("DELETE", "urn:g", "urn:a", None)], schema)
    log.coalesce(1).write.parquet(f"{tmp_path}/log")
    seen = []
    q = stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/log"), lambda df, _: seen.extend(rows(df.select("event", "resource"))), f"{tmp_path}/state")
    q.awaitTermination()
    assert sorted(seen) == [("CREATE", "urn:a"), ("DELETE", "urn:a")]
