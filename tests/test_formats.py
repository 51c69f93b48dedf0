"""RDF and result documents, read and written."""

import json

import pytest
from graphs import PEOPLE, PREFIX, rows, session

from graphloom.errors import ParseError, Unsupported
from graphloom.session import Namespaces
from graphloom.sources import rdf, results


def quads(text, **kw):
    return {(s, p, o, g) for s, p, o, g in rdf.parse_turtle(text, **kw)}


def test_turtle_syntax():
    text = """@base <http://b/> . PREFIX x: <http://x/> # comment
    <a> a x:T ; x:p "one", 'two'@EN , \"\"\"th"ree\nlines\"\"\" ; x:q 1 , -2.5 , 1e3 , true ; .
    x:b\\-c x:r [ x:s ( 1 2 ) ] . _:l x:t "5"^^<http://www.w3.org/2001/XMLSchema#long> , "\\u00e9\\t" .
    """
    got = quads(text)
    objects = {o for _, p, o, _ in got if p in ("http://x/p", "http://x/q", "http://x/t")}
    assert objects == {("string", "one", None), ("lang", "two", "en"), ("string", 'th"ree\nlines', None), ("integer", "1", None), ("double", "-2.5", None), ("double", "1e3", None), ("boolean", "true", None), ("integer", "5", None), ("string", "é\t", None)}
    assert {s for s, p, _, _ in got if p == "http://x/r"} == {"http://x/b-c"}
    assert ("http://b/a", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", ("iri", "http://x/T", None), None) in got


def test_trig_graphs():
    got = rdf.parse_turtle("@prefix x: <urn:x:> . x:a x:p 1 . x:g { x:b x:p 2 . x:c x:p 3 } GRAPH x:h { x:d x:p 4 } { x:e x:p 5 }")
    assert [(s[-1], g and g[-1]) for s, _, _, g in got] == [("a", None), ("b", "g"), ("c", "g"), ("d", "h"), ("e", None)]


def test_json_ld():
    doc = {"@context": {"x": "urn:x:", "name": "urn:x:name", "knows": {"@id": "x:knows", "@type": "@id"}}, "@graph": [{"@id": "x:a", "@type": "x:T", "name": "A", "knows": "x:b", "x:n": [1, 2.5, True], "x:l": {"@value": "h", "@language": "de"}, "x:items": {"@list": [1]}}, {"@id": "x:g", "@graph": [{"@id": "x:z", "name": "Z"}]}]}
    got = {(s, p, o[1], g) for s, p, o, g in rdf.parse_jsonld(json.dumps(doc))}
    assert {("urn:x:a", "urn:x:knows", "urn:x:b", None), ("urn:x:a", "urn:x:name", "A", None), ("urn:x:a", "urn:x:n", "true", None), ("urn:x:z", "urn:x:name", "Z", "urn:x:g")} <= got
    with pytest.raises(ParseError):
        rdf.parse_jsonld("{")
    with pytest.raises(Unsupported):
        rdf.parse_jsonld('{"@context": "http://remote/", "@id": "x"}')


def test_round_trips(spark):
    held = rdf.to_frame(spark, rdf.parse_turtle(PEOPLE)).union(rdf.to_frame(spark, rdf.parse_turtle(PREFIX + '<urn:z> t:note "q\\"\\n\\\\" .'), "urn:g"))
    collected = [tuple(r) for r in held.collect()]
    named = lambda text, parse: {(g, s, p, tuple(o)) for s, p, o, g in parse(text) if "bnode" not in s and "bnode" not in o[1]}
    want = {(None if g == "urn:graphloom:default-graph" else g, s, p, tuple(o)) for g, s, p, o in collected if "bnode" not in s and "bnode" not in o[1]}
    assert named(rdf.to_trig(collected), rdf.parse_turtle) == want
    assert named(rdf.to_jsonld(collected), rdf.parse_jsonld) == want
    lines = "\n".join(r[0] for r in rdf.turtle_lines(held).where("g = 'urn:g'").collect())
    assert named(lines, rdf.parse_turtle) == {(None, s, p, o) for g, s, p, o in want if g == "urn:g"}


def test_files_are_read_in_parallel_and_blank_nodes_kept_apart(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("_:x <urn:p> 1 .")
    (tmp_path / "b.ttl").write_text("_:x <urn:p> 2 .")
    (tmp_path / "c.jsonld").write_text('{"@id": "urn:s", "urn:p": 3}')
    got = rows(rdf.read_quads(spark, f"file://{tmp_path}/*"))
    assert len(got) == 3 and len({s for _, s, _, _ in got}) == 3


def test_results(spark):
    df = session(spark).query("SELECT ?x ?n ?a { ?x a t:Person ; t:called ?n OPTIONAL { ?x t:age ?a } } ORDER BY ?x")
    doc = json.loads(results.to_json(df))
    assert doc["head"]["vars"] == ["x", "n", "a"]
    first = doc["results"]["bindings"][0]
    assert first["x"] == {"type": "uri", "value": "urn:ann"} and first["a"]["datatype"].endswith("#integer")
    assert "a" not in doc["results"]["bindings"][2]
    want = [("urn:ann", "Ann", "40"), ("urn:bob", "bob", "30"), ("urn:cat", "The Cat", None), ("urn:dan", "Dan", "30")]
    assert rows(results.from_json(spark, results.to_json(df))) == want
    assert rows(results.from_xml(spark, results.to_xml(df))) == want
    yes = session(spark).query("ASK { ?x t:age 40 }")
    assert json.loads(results.to_json(yes)) == {"head": {}, "boolean": True}
    for bad in ("{", "[]"):
        with pytest.raises(ParseError):
            results.from_json(spark, bad)
    with pytest.raises(ParseError):
        results.from_xml(spark, "<a>")


def test_namespaces():
    n = Namespaces({"x": "urn:x:"})
    n.add("xy", "urn:x:y:")
    assert n.expand("x:a") == "urn:x:a" and n.expand("q:a") == "q:a"
    assert n.compress("urn:x:y:b") == "xy:b" and n.compress("urn:z") == "urn:z"


def test_command_line(spark, sf_dir, tmp_path, capsys):
    from graphloom import cli

    cli.main(["query", "SELECT ?n { ?r a :Region ; :name ?n }", "--tables", sf_dir, "--format", "json"])
    assert len(json.loads(capsys.readouterr().out)["results"]["bindings"]) == 5
    cli.main(["introspect", "--tables", sf_dir])
    assert "class :Region" in capsys.readouterr().out
