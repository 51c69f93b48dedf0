"""Query semantics on a small graph of people: cycles, unbound values, mixed types."""

import pytest
from graphs import PREFIX, rows, session

from graphloom.errors import ConstraintViolation, GraphError, ParseError, QueryFailed, UnknownClass, UnknownProperty, Unsupported
from graphloom.sources.rdf import parse_turtle, to_frame


@pytest.fixture(scope="module")
def people(spark):
    return session(spark)


def ask(s, text, **params):
    return sorted(rows(s.query(text, **params)), key=repr)


@pytest.mark.parametrize(
    "text,want",
    [
        # patterns and joins
        ("SELECT ?n { ?x a t:Team ; t:called ?n }", [("A Red team",)]),
        ("SELECT ?x { ?x a t:Agent ; t:age 30 }", [("urn:bob",), ("urn:dan",)]),
        ("SELECT ?l { <urn:ann> rdfs:label ?l }", [("Ann",)]),
        ("SELECT ?a ?b { ?a t:knows ?b }", [("urn:ann", "urn:bob"), ("urn:bob", "urn:cat"), ("urn:cat", "urn:ann")]),
        ("SELECT ?x { ?x t:score 4.0 }", [("urn:bob",)]),
        ("SELECT ?x { ?x t:knows [ t:called 'Ann' ] }", [("urn:cat",)]),
        ("SELECT ?x { ?t t:items ( ?x <urn:bob> ) }", [("urn:ann",)]),
        ("SELECT ?x ?a { ?x a t:Person OPTIONAL { ?x t:age ?a } }", [("urn:ann", 40), ("urn:bob", 30), ("urn:cat", None), ("urn:dan", 30)]),
        ("SELECT ?x ?a { ?x a t:Person OPTIONAL { ?x t:age ?a FILTER (?a > 35) } }", [("urn:ann", 40), ("urn:bob", None), ("urn:cat", None), ("urn:dan", None)]),
        ("SELECT ?x ?y { ?x a t:Person OPTIONAL { ?x t:age ?a } OPTIONAL { ?y t:age ?a ; t:called 'Ann' } FILTER (?x = <urn:cat>) }", [("urn:cat", "urn:ann")]),
        ("SELECT ?x ?t { { ?x t:age 40 } UNION { ?t t:member <urn:dan> } }", [("urn:ann", None), (None, "urn:red")]),
        ("SELECT ?x { ?x a t:Person MINUS { ?x t:age 30 } }", [("urn:ann",), ("urn:cat",)]),
        ("SELECT ?x { ?x t:age 40 MINUS { ?y t:age 30 } }", [("urn:ann",)]),
        ("SELECT ?x { ?x a t:Person FILTER NOT EXISTS { ?x t:knows ?y } }", [("urn:dan",)]),
        ("SELECT ?x { ?x a t:Person FILTER EXISTS { ?x t:score ?s FILTER (?s > 3) } }", [("urn:bob",)]),
        ("SELECT ?x ?v { VALUES (?x ?v) { (<urn:ann> 1) (<urn:dan> UNDEF) } ?x t:age ?a }", [("urn:ann", 1), ("urn:dan", None)]),
        ("SELECT ?x { ?x t:age ?a FILTER (?a = (SELECT (MAX(?b) AS ?m) { ?y t:age ?b })) }", [("urn:ann",)]),
        # unbound predicates carry mixed types
        ("SELECT ?o { <urn:dan> ?p ?o FILTER (?p = t:age || ?p = t:called) }", [("30",), ("Dan",)]),
        ("SELECT ?o { <urn:ann> ?p ?o FILTER (isNumeric(?o) && ?o < 2) }", [("1.5",)]),
        # aggregates
        ("SELECT (COUNT(*) AS ?n) (SUM(?a) AS ?s) (AVG(?a) AS ?m) (MIN(?a) AS ?lo) (MAX(?a) AS ?hi) (COUNT(DISTINCT ?a) AS ?d) { ?x t:age ?a }", [(3, 100, 100 / 3, 30, 40, 2)]),
        ("SELECT (SUM(?a) AS ?s) (GROUP_CONCAT(?a) AS ?g) (COUNT(?a) AS ?n) { ?x t:age ?a FILTER (?a > 99) }", [(0, "", 0)]),
        ("SELECT ?a (GROUP_CONCAT(?n; SEPARATOR='+') AS ?g) { ?x t:age ?a ; t:called ?n } GROUP BY ?a HAVING (COUNT(*) > 1) (?a < 35)", [(30, "Dan+bob")]),
        ("SELECT (STRLEN(SAMPLE(?n)) + 1 AS ?k) { ?x t:age 40 ; t:called ?n }", [(4,)]),
        ("SELECT ?k (COUNT(?x) AS ?n) { ?x t:age ?a } GROUP BY (?a / 10 AS ?k)", [(3.0, 2), (4.0, 1)]),
        # paths over a cycle
        ("SELECT ?y { <urn:ann> t:knows+ ?y }", [("urn:ann",), ("urn:bob",), ("urn:cat",)]),
        ("SELECT ?x { ?x t:knows+ <urn:bob> }", [("urn:ann",), ("urn:bob",), ("urn:cat",)]),
        ("SELECT ?y { <urn:dan> t:knows* ?y }", [("urn:dan",)]),
        ("SELECT ?y { <urn:ann> t:knows? ?y }", [("urn:ann",), ("urn:bob",)]),
        ("SELECT ?x ?y { ?x (t:knows/t:knows)+ ?y FILTER (?x = <urn:ann>) }", [("urn:ann", "urn:ann"), ("urn:ann", "urn:bob"), ("urn:ann", "urn:cat")]),
        ("SELECT ?n { <urn:red> t:member/t:called ?n }", [("Ann",), ("Dan",)]),
        ("SELECT ?t { <urn:ann> ^t:member ?t }", [("urn:red",)]),
        ("SELECT ?v { <urn:bob> t:age|t:score ?v }", [("30",), ("4.0",)]),
        ("SELECT ?v { <urn:dan> !(rdf:type|rdfs:label|t:called) ?v }", [("30",)]),
        ("SELECT ?e { ?t t:items/rdf:rest*/rdf:first ?e }", [("urn:ann",), ("urn:bob",)]),
        # functions over typed and language values
        ("SELECT (LANG(?m) AS ?l) { ?x t:motto ?m FILTER LANGMATCHES(LANG(?m), 'EN') }", [("en-gb",)]),
        ("SELECT ?x { ?x t:motto 'hallo'@de }", [("urn:bob",)]),
        ("SELECT ?x { ?x t:motto 'hallo' }", []),
        ("SELECT (YEAR(?b) AS ?y) (HOURS(?b) AS ?h) (SECONDS(?b) AS ?s) (TZ(?b) AS ?z) (TIMEZONE(?b) AS ?t) { ?x t:born ?b }", [(1980, 5, 7.25, "+02:00", "PT2H")]),
        ("SELECT ?x { ?x t:born ?b FILTER (?b = '1980-03-04T03:06:07.25Z'^^xsd:dateTime) }", [("urn:ann",)]),
        ("SELECT (7 / 2 AS ?a) (1 / 0 AS ?b) (xsd:integer('x') AS ?c) (SUBSTR('hello', 0, 3) AS ?d) (STRAFTER('abc', 'z') AS ?e) { }", [(3.5, None, None, "he", "")]),
        ("SELECT (REPLACE('abcb', 'B', 'x', 'i') AS ?a) (REGEX('Ab', '^a', 'i') AS ?b) (IF(1 > 2, 'y', 'n') AS ?c) (COALESCE(?u, 'z') AS ?d) (BOUND(?u) AS ?e) { }", [("axcx", True, "n", "z", False)]),
        ("SELECT (CONTAINS('a*b', '*') AS ?a) (STRENDS('ab', '?') AS ?b) { }", [(True, False)]),
        ("SELECT (t:called(?y) AS ?n) { <urn:ann> t:knows ?y }", [("bob",)]),
        ("SELECT (t:score(?x) AS ?s) { ?x t:called 'Ann' }", [("1.5,2.5",)]),
        # full text: all words anywhere, the last one a prefix, phrases within one value
        ("SELECT ?x { ?x fts:match 'green te' }", [("urn:ann",), ("urn:cat",)]),
        ("SELECT ?x { ?x fts:match '\"green tea\"' }", [("urn:ann",)]),
        ("SELECT ?x { ?x fts:match 'gree tea' }", []),
        # modifiers
        ("SELECT DISTINCT ?a { ?x t:age ?a }", [(30,), (40,)]),
        ("ASK { ?x t:age 40 }", [("true",)]),
        ("ASK { ?x t:age 41 }", [("false",)]),
        ("SELECT ?x { ?x t:called ?n FILTER (?n IN ('Ann', 'Dan') && ?x NOT IN (<urn:dan>)) }", [("urn:ann",)]),
    ],
)
def test_rows(people, text, want):
    assert ask(people, text) == sorted(want, key=repr)


def test_order_is_by_collation_with_unbound_first(people):
    assert [r[0] for r in rows(people.query("SELECT ?n { ?x t:called ?n } ORDER BY ?n"))] == ["A Red team", "Ann", "bob", "Dan", "The Cat"]
    assert [r[0] for r in rows(people.query("SELECT ?x { ?x a t:Person OPTIONAL { ?x t:age ?a } } ORDER BY ?a ?x LIMIT 2"))] == ["urn:cat", "urn:bob"]
    assert [r[0] for r in rows(people.query("SELECT ?n { ?x t:called ?n } ORDER BY gl:title-order(?n)"))] == ["Ann", "bob", "The Cat", "Dan", "A Red team"]
    assert [r[0] for r in rows(people.query("SELECT ?n { ?x t:called ?n } ORDER BY DESC(?n) LIMIT 2 OFFSET 1"))] == ["Dan", "bob"]


def test_rank_weighs_properties(spark):
    s = session(spark, PREFIX + '<urn:a> a t:Team ; t:called "blue" ; t:note "x y" . <urn:b> a t:Team ; t:called "x" ; t:note "blue y" .')
    got = dict(rows(s.query("SELECT ?x (fts:rank(?x) AS ?r) { ?x fts:match 'blue' }")))
    assert got["urn:a"] > got["urn:b"] > 0


def test_construct_and_describe(people):
    got = ask(people, "CONSTRUCT { ?b t:knows ?a } WHERE { ?a t:knows ?b ; t:age ?n FILTER (?n > 35) }")
    assert got == [("urn:bob", "urn:t#knows", "urn:ann")]
    told = {(p, o) for _, p, o, _ in rows(people.query("DESCRIBE <urn:dan>"))}
    assert ("urn:t#age", "30") in told and ("http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "urn:t#Agent") in told


def test_parameters(people):
    q = people.prepare("SELECT ?x { ?x t:age ~age ; t:called ?n FILTER (STRSTARTS(?n, ~start)) } LIMIT ~n")
    assert rows(q.bind(age=30, start="D", n=5).execute()) == [("urn:dan",)]
    with pytest.raises(QueryFailed):
        q.bind(age=30).execute()


@pytest.fixture(scope="module")
def graphs(spark):
    s = session(spark, "")
    quads = [(x, "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", ("iri", "urn:t#Person", None), g) for x, g in (("urn:a", "urn:g1"), ("urn:b", "urn:g2"), ("urn:a", "urn:g2"), ("urn:c", None))]
    s.load(to_frame(spark, quads))
    return s


@pytest.mark.parametrize(
    "text,want",
    [
        ("SELECT ?x { GRAPH <urn:g1> { ?x a t:Person } }", [("urn:a",)]),
        ("SELECT ?g ?x { GRAPH ?g { ?x a t:Person } }", [("urn:g1", "urn:a"), ("urn:g2", "urn:a"), ("urn:g2", "urn:b")]),
        ("SELECT ?x { ?x a t:Person }", [("urn:a",), ("urn:b",), ("urn:c",)]),
        ("SELECT ?x FROM <urn:g2> { ?x a t:Person }", [("urn:a",), ("urn:b",)]),
        ("SELECT ?x FROM NAMED <urn:g1> { ?x a t:Person }", []),
        ("SELECT ?g ?x FROM NAMED <urn:g1> { GRAPH ?g { ?x a t:Person } }", [("urn:g1", "urn:a")]),
        ("SELECT ?x { GRAPH <urn:none> { ?x a t:Person } }", []),
        ("SELECT ?g { GRAPH ?g { } }", [("urn:g1",), ("urn:g2",)]),
        ("CONSTRAINT GRAPH <urn:g1> SELECT ?x { ?x a t:Person }", [("urn:a",)]),
        ("CONSTRAINT GRAPH DEFAULT SELECT ?x { ?x a t:Person }", [("urn:c",)]),
        ("CONSTRAINT GRAPH <urn:g1> CONSTRAINT GRAPH <urn:g2> SELECT ?x { ?x a t:Person }", []),
    ],
)
def test_graphs(graphs, text, want):
    assert ask(graphs, text) == want


@pytest.mark.parametrize(
    "text,error",
    [
        ("SELECT ?x { ?x t:nothing ?y }", UnknownProperty),
        ("SELECT ?x { ?x a t:Nothing }", UnknownClass),
        ("SELECT ?x { ?x u:p ?y }", ParseError),
        ("SELECT { ?x t:age ?y }", ParseError),
        ("SELECT ?x ?x t:age ?y }", ParseError),
        ("SELECT ?x { ?x t:age ?y ", ParseError),
        ("SELECT ?x { ?x t:age ?a BIND (1 AS ?a) }", ParseError),
        ("SELECT ?x { ?x t:called ?n FILTER (REGEX(?n, 'a', 'q')) }", ParseError),
        ("SELECT (REPLACE('a', 'x*', 'y') AS ?r) { }", ParseError),
        ("SELECT (nope(1) AS ?r) { }", ParseError),
        ("SELECT (t:nope(1) AS ?r) { }", ParseError),
        ("SELECT (STRLEN('a', 'b') AS ?r) { }", ParseError),
        ("SELECT ?x { VALUES (?x ?y) { (1) } }", ParseError),
        ("SELECT ?x { ?x t:age ?a FILTER (COUNT(?a) > 1) }", ParseError),
        ("SELECT (gl:normalize('a', 'nfx') AS ?r) { }", ParseError),
        ("SELECT ?x { ?x fts:match '' }", ParseError),
        ("SELECT ?x { SERVICE <urn:nowhere> { ?x t:age ?a } }", QueryFailed),
        ("SELECT ?x { ?x t:called 'a }", ParseError),
        ("SELECT ?x { ?x !() ?y }", ParseError),
        ("DESCRIBE", ParseError),
    ],
)
def test_errors(people, text, error):
    with pytest.raises(error):
        people.query(text).collect()


def test_services(spark, people):
    other = session(spark, PREFIX + '<urn:zoe> a t:Person ; t:called "Ann" ; t:age 7 .')
    s = session(spark, services={"urn:s": other.data})
    assert ask(s, "SELECT ?x ?z { ?x a t:Person ; t:called ?n SERVICE <urn:s> { ?z t:called ?n } }") == [("urn:ann", "urn:zoe")]
    assert len(ask(s, "SELECT ?x { ?x a t:Person SERVICE SILENT <urn:none> { ?z t:called ?n } }")) == 4
    with pytest.raises(QueryFailed):
        s.query("CONSTRAINT SERVICE <urn:other> SELECT ?z { SERVICE <urn:s> { ?z t:called ?n } }").collect()


def test_minus_is_the_dual_of_exists(people):
    a = ask(people, "SELECT ?x { ?x a t:Person MINUS { ?x t:score ?s } }")
    b = ask(people, "SELECT ?x { ?x a t:Person FILTER NOT EXISTS { ?x t:score ?s } }")
    assert a == b == [("urn:cat",), ("urn:dan",)]


def test_malformed_documents():
    for text in ("<urn:a> <urn:b> .", "<urn:a> <urn:b> 'x", "@prefix x <urn:x> .", "x:a x:b x:c .", "<urn:a> <urn:b> <urn:c>"):
        with pytest.raises(GraphError):
            parse_turtle(text)
    assert issubclass(Unsupported, GraphError) and issubclass(ConstraintViolation, GraphError)


def test_full_text_options(spark):
    from graphloom.operators.fts import Analysis
    from graphloom.session import Options

    data = PREFIX + '<urn:a> a t:Team ; t:note "Cafés serve 42 the berries" . <urn:b> a t:Team ; t:note "cafe the berry 7" .'
    plain = session(spark, data)
    assert ask(plain, "SELECT ?x { ?x fts:match 'cafe' }") == [("urn:b",)]
    s = session(spark, data, options=Options(analysis=Analysis(unaccent=True, stemmer=True, ignore_numbers=True, stop_words=("the",))))
    assert ask(s, "SELECT ?x { ?x fts:match 'cafés the berries' }") == [("urn:a",), ("urn:b",)]
    with pytest.raises(ParseError):
        ask(s, "SELECT ?x { ?x fts:match '42' }")


def test_ids_and_iris(people):
    assert ask(people, "SELECT ?y { <urn:ann> t:knows ?x BIND (gl:uri(gl:id(?x)) AS ?y) }") == [("urn:bob",)]


def test_endpoint_and_remote_service(spark, people):
    from graphloom.endpoint import Endpoint, Remote, constrained, negotiated

    e = Endpoint(people)
    try:
        r = Remote(e.url)
        assert rows(r.query(spark, "SELECT ?x ?a { ?x t:age ?a } ORDER BY ?x LIMIT 1")) == [("urn:ann", "40")]
        assert "urn:t#age" in r.document("DESCRIBE <urn:dan>", "text/turtle")
        assert "<binding" in r.document("SELECT ?x { ?x t:age 40 }", "application/sparql-results+xml")
        with pytest.raises(QueryFailed, match="400 ParseError"):
            r.document("SELECT")
        with pytest.raises(QueryFailed, match="406"):
            r.document("ASK { }", "image/png")
        s = session(spark, PREFIX + '<urn:eve> a t:Person ; t:called "Ann" ; t:age 40 .', services={e.url: r})
        assert ask(s, f"SELECT ?y ?z {{ ?y t:age ?a SERVICE <{e.url}> {{ ?z t:age ?a }} }}") == [("urn:eve", "urn:ann")]
    finally:
        e.close()
    with pytest.raises(QueryFailed):
        r.document("ASK { }")
    assert constrained("Q", ["DEFAULT", "urn:g"], []) == "CONSTRAINT GRAPH DEFAULT, <urn:g>\nCONSTRAINT SERVICE <urn:none>\nQ"
    assert negotiated("text/x, application/xml;q=0.5, */*;q=0.1", {"application/xml": "xml", "a/b": "c"}, "a/b") == "application/xml"


def test_blank_nodes_of_two_updates_stay_apart(spark):
    s = session(spark, "")
    for _ in range(2):
        s.update("INSERT DATA { _:x a t:Person ; t:called 'same' }")
    assert len(ask(s, "SELECT ?x { ?x t:called 'same' }")) == 2


def test_batches_and_documents(spark, people, tmp_path):
    from graphloom.resource import Resource

    (tmp_path / "x.ttl").write_text(PREFIX + "<urn:f> a t:Person ; t:age 5 .")
    s = session(spark, "")
    s.batch().add_rdf(f"file://{tmp_path}/x.ttl").add_update("INSERT DATA { <urn:g> a t:Person ; t:age 6 }").add_resource(Resource("urn:h").a("urn:t#Person").set("urn:t#age", 7)).execute()
    assert ask(s, "SELECT ?x { ?x t:age ?a }") == [("urn:f",), ("urn:g",), ("urn:h",)]
    with pytest.raises(ConstraintViolation):
        s.batch().add_update("INSERT DATA { <urn:i> a t:Person }").add_update("INSERT DATA { <urn:g> t:age 7 }").execute()
    assert ask(s, "SELECT ?x { <urn:i> a ?x }") == []
    text = people.serialize("CONSTRUCT { ?x t:age ?a } WHERE { ?x t:age ?a }")
    assert {(q[0], q[2]) for q in parse_turtle(text)} == {("urn:ann", ("integer", "40", None)), ("urn:bob", ("integer", "30", None)), ("urn:dan", ("integer", "30", None))}
    with pytest.raises(Unsupported):
        people.serialize("SELECT ?x { ?x t:age ?a }", "turtle")
    s.export(f"file://{tmp_path}/out")
    again = session(spark, "")
    again.deserialize(f"file://{tmp_path}/x.ttl")
    assert ask(again, "SELECT ?x { ?x t:age 5 }") == [("urn:f",)]


def test_values_take_the_range_of_their_property(spark):
    from graphloom.errors import TypeMismatch

    s = session(spark, PREFIX + '<urn:a> a t:Person ; t:age "41" ; t:score 2 , "x" ; t:born "1999-01-02"^^xsd:date .')
    assert ask(s, "SELECT ?a ?s (YEAR(?b) AS ?y) { ?x t:age ?a ; t:score ?s ; t:born ?b }") == [(41, 2.0, 1999)]
    with pytest.raises(TypeMismatch):
        s.update("INSERT DATA { <urn:b> a t:Person ; t:age 'old' }")


def test_strict_syntax_and_anonymous_blank_nodes(spark):
    from graphloom.session import Options

    s = session(spark, PREFIX + '[ a t:Person ; t:called "x" ] .', options=Options(strict_syntax=True, anonymous_bnodes=True))
    (node,) = ask(s, "SELECT ?x { ?x t:called 'x' }")[0]
    assert node.startswith("_:")
    for text in ("SELECT ?n STRLEN(?n) { ?x t:called ?n }", "SELECT (STRLEN(?n)) { ?x t:called ?n }", "SELECT ?x { ?x t:age ~a }", "CONSTRAINT GRAPH DEFAULT SELECT ?x { ?x t:age 1 }", "SELECT (GROUP_CONCAT(?n, '-') AS ?g) { ?x t:called ?n }", "SELECT ?x { ?x t:age ?a FILTER (?a = (SELECT ?b { ?y t:age ?b })) }"):
        with pytest.raises(ParseError, match="strict"):
            s.query(text)
    for text in ("INSERT OR REPLACE { <urn:a> t:age 1 }", "INSERT DATA { <urn:a> t:age NULL }"):
        with pytest.raises(ParseError, match="strict"):
            s.update(text)
