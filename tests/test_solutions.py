"""Joins of solutions with unbound variables against brute force, and the plans that they give."""

import itertools
import random

import pytest
from graphs import rows, session

from graphloom import queries
from graphloom.plans.solutions import Sol, fresh, join, minus, semi
from graphloom.session import GraphSession
from graphloom.sources.tables import dataset
from graphloom.terms import DOUBLE, INTEGER, STRING

VARS = {"x": INTEGER, "y": STRING, "z": INTEGER}
SQL = {INTEGER: "bigint", DOUBLE: "double", STRING: "string"}


def solution(spark, names: dict, data: list[dict], bound: set) -> Sol:
    out = {v: (fresh(v), t) for v, t in names.items()}
    schema = ", ".join(f"{c} {SQL[t]}" for c, t in out.values())
    return Sol(spark.createDataFrame([tuple(r.get(v) for v in names) for r in data], schema), out, frozenset(bound))


def told(sol: Sol, names) -> list:
    rows = sol.df.select(*(sol.col(v) for v in names)).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def compatible(a: dict, b: dict) -> bool:
    return all(a.get(v) is None or b.get(v) is None or a[v] == b[v] for v in a.keys() & b.keys())


def sharing(a: dict, b: dict) -> bool:
    return any(a[v] is not None and b[v] is not None for v in a.keys() & b.keys())


def merged(a: dict, b: dict) -> dict:
    return {v: a.get(v) if a.get(v) is not None else b.get(v) for v in (*a, *b)}


def some(r: random.Random, names, loose: set, n: int) -> list[dict]:
    value = {"x": lambda: r.randrange(3), "y": lambda: r.choice("ab"), "z": lambda: r.randrange(2), "u": lambda: r.randrange(9), "w": lambda: r.randrange(9)}
    return [{v: None if v in loose and r.random() < 0.4 else value[v]() for v in names} for _ in range(n)]


@pytest.mark.parametrize("loose_l,loose_r", [(set(), {"x"}), ({"x"}, set()), ({"x"}, {"x"}), ({"x", "y"}, {"y", "z"}), ({"x", "y", "z"}, {"x", "y", "z"})])
def test_compatible_rows(spark, loose_l, loose_r):
    r = random.Random(len(loose_l) * 10 + len(loose_r))
    a, b = some(r, ("x", "y", "z", "u"), loose_l, 12), some(r, ("x", "y", "z", "w"), loose_r, 9)
    left = solution(spark, VARS | {"u": INTEGER}, a, {"x", "y", "z", "u"} - loose_l)
    right = solution(spark, VARS | {"w": INTEGER}, b, {"x", "y", "z", "w"} - loose_r)
    names = ("x", "y", "z", "u", "w")
    row = lambda m: tuple(m.get(v) for v in names)
    inner = [merged(p, q) for p, q in itertools.product(a, b) if compatible(p, q)]
    assert told(join(left, right), names) == sorted(map(row, inner), key=repr)
    alone = [p for p in a if not any(compatible(p, q) for q in b)]
    assert told(join(left, right, "left"), names) == sorted(map(row, inner + alone), key=repr)
    own = lambda ps: sorted((tuple(p[v] for v in ("x", "y", "z", "u")) for p in ps), key=repr)
    assert told(semi(left, right, True), names[:4]) == own(alone)
    assert told(semi(left, right, False), names[:4]) == own([p for p in a if any(compatible(p, q) for q in b)])
    assert told(minus(left, right), names[:4]) == own([p for p in a if not any(compatible(p, q) and sharing(p, q) for q in b)])


@pytest.mark.parametrize("name", ["optional_unbound_join", "values_many_undef", "minus_optional"])
def test_unbound_sides_meet_in_equi_joins(spark, sf_dir, name):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_mixed_numbers_keep_kind_and_order(spark):
    data = "\n".join(f'<urn:p{k}> a t:Person ; t:called "p{k}" ; t:age {a} ; t:score {b} .' for k, (a, b) in enumerate(((9, 1.5), (10, 70.25), (100, -3.0), (9007199254740993, 2.0), (9007199254740992, 1e300))))
    s = session(spark, _prefixed(data))
    q = "SELECT ?v { ?x ?p ?v FILTER (?p IN (t:age, t:score)) } ORDER BY ?v"
    ordered = [r[0] for r in rows(s.query(q))]
    assert ordered == ["-3.0", "1.5", "2.0", "9", "10", "70.25", "100", "9007199254740992", "9007199254740993", "1e+300"]
    assert [r[0] for r in rows(s.query(q.replace("ORDER BY ?v", "ORDER BY DESC(?v)")))] == ordered[::-1]
    assert rows(s.query("SELECT (MIN(?v) AS ?a) (MAX(?v) AS ?b) { ?x ?p ?v FILTER (?p = t:age) }")) == [("9", "9007199254740993")]
    assert rows(s.query("SELECT (SUM(?v) AS ?a) (DATATYPE(SUM(?v)) AS ?t) { ?x ?p ?v FILTER (?p = t:age && ?v < 1000) }")) == [("119", "http://www.w3.org/2001/XMLSchema#integer")]
    less = "SELECT (COUNT(*) AS ?n) { ?x ?p ?v . ?y ?q ?w FILTER (?p = t:age && ?q = t:score && ?v < ?w) }"
    assert rows(s.query(less)) == [(2 + 5,)]
    assert rows(s.query(less.replace("?v < ?w", "?v >= ?w"))) == [(25 - 7,)]
    assert rows(s.query("SELECT (COUNT(DISTINCT ?v) AS ?n) { ?x (t:age|t:score) ?v }")) == [(10,)]


def _prefixed(text: str) -> str:
    from graphs import PREFIX

    return PREFIX + text


def test_schema_is_data(spark):
    s = session(spark)
    assert sorted(rows(s.query("SELECT ?p { ?p rdfs:domain t:Team }"))) == [("urn:t#member",)]
    assert sorted(rows(s.query("SELECT ?c { ?c rdfs:subClassOf t:Agent }"))) == [("urn:t#Person",), ("urn:t#Team",)]
    assert rows(s.query("SELECT ?r ?m { t:age rdfs:range ?r ; ont:maxCardinality ?m ; a rdf:Property }")) == [("http://www.w3.org/2001/XMLSchema#integer", 1)]
    assert sorted(rows(s.query("SELECT ?x ?v { ?x ?p ?v . ?p rdfs:range xsd:double FILTER (!STRSTARTS(STR(?p), STR(ont:)) && ?x != ?p) }".replace("STR(ont:)", "'urn:graphloom'")))) == [("urn:ann", "1.5"), ("urn:ann", "2.5"), ("urn:bob", "4.0")]
    assert sorted(rows(s.query("SELECT ?c { ?c rdfs:subClassOf+ rdfs:Resource FILTER STRSTARTS(STR(?c), 'urn:t') }"))) == [("urn:t#Agent",), ("urn:t#Person",), ("urn:t#Team",)]
    assert s.ask("ASK { t:Person a rdfs:Class ; ont:notify true }") and not s.ask("ASK { t:Team ont:notify true }")
    assert rows(s.query("SELECT ?p ?o { GRAPH ?g { t:Person ?p ?o } }")) == []
    t = GraphSession(spark, s.data.ontology)
    assert ("urn:t#Person", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://www.w3.org/2000/01/rdf-schema#Class") in {r[:3] for r in rows(t.query("DESCRIBE t:Person"))}


def test_exists_in_an_expression_sees_outer_variables(spark):
    s = session(spark)
    q = "SELECT ?x { ?x t:age ?a FILTER (EXISTS { ?x t:score ?w FILTER (?w * 10 < ?a) } || ?a < 0) }"
    assert rows(s.query(q)) == [("urn:ann",)]
    assert sorted(rows(s.query("SELECT ?x (NOT EXISTS { ?x t:score ?w FILTER (?w * 10 < ?a) } AS ?n) { ?x t:age ?a }"))) == [("urn:ann", False), ("urn:bob", True), ("urn:dan", True)]
    assert sorted(rows(s.query("SELECT ?x { ?x t:called ?n OPTIONAL { ?x t:age ?a } FILTER (EXISTS { ?y t:age ?a } && ?n != 'Dan') }"))) == [("urn:ann",), ("urn:bob",), ("urn:cat",), ("urn:red",)]


def test_tables_stay_scans_beside_updates(spark, sf_dir):
    s = GraphSession(spark, dataset(spark, sf_dir, ["orders", "customer"]))
    n = s.query("SELECT ?o { ?o a :Order }").count()
    s.update("INSERT DATA { <http://data/order/new> a :Order ; :orderstatus 'N' }", "DELETE DATA { <http://data/customer/3> a rdfs:Resource }")
    assert s.query("SELECT ?o { ?o a :Order }").count() == n + 1
    star = s.query("SELECT ?o ?s ?p { ?o :orderstatus ?s ; :orderpriority ?p }")
    assert star.count() == n
    plan = star._jdf.queryExecution().executedPlan().toString()
    assert "o_orderstatus" in plan and "o_totalprice" not in plan
