"""Durable stores, deltas and the stored text index."""

import pytest
from graphs import ONTOLOGY, PEOPLE, PREFIX, _parts, rows, session

from graphloom.errors import Conflict, OntologyMissing, OpenFailed
from graphloom.ontology import Ontology
from graphloom.session import GraphSession
from graphloom.sources.rdf import parse_turtle, to_frame
from graphloom.sources.tables import dataset


def ontology() -> Ontology:
    return Ontology.of(*_parts(ONTOLOGY))


def names(s) -> list:
    return sorted(r[0] for r in rows(s.query("SELECT ?n { ?x t:called ?n }")))


def test_a_store_opens_again(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    with pytest.raises(OntologyMissing):
        GraphSession.open(spark, path)
    s = GraphSession.open(spark, path, ontology())
    s.load(to_frame(spark, parse_turtle(PEOPLE)))
    s.update("CREATE GRAPH <urn:empty>", "INSERT DATA { GRAPH <urn:g> { <urn:eve> a t:Person ; t:called 'Eve' } }")
    s.update("DELETE { ?x t:called ?n } INSERT { ?x t:called 'Robert' } WHERE { ?x t:called ?n FILTER (?n = 'bob') }")
    want = ["A Red team", "Ann", "Dan", "Eve", "Robert", "The Cat"]
    assert names(s) == want
    t = GraphSession.open(spark, path)
    assert names(t) == want and t.data.graphs >= {"urn:empty"}
    assert rows(t.query("SELECT ?n { <urn:ann> t:knows ?y . ?y t:called ?n }")) == [("Robert",)]
    versions = t.store.versions()
    assert "bob" in names(GraphSession.open(spark, path, version=versions[-2]))
    with pytest.raises(OpenFailed):
        GraphSession.open(spark, path, version=99)
    t.update("CLEAR DEFAULT")
    with pytest.raises(Conflict):  # ``s`` still stands on the version before
        s.update("INSERT DATA { <urn:fay> a t:Person ; t:called 'Fay' }")
    u = GraphSession.open(spark, path)
    assert names(u) == ["Eve"]
    u.store.vacuum()
    assert u.store.versions() == [versions[-1] + 1] and names(GraphSession.open(spark, path)) == ["Eve"]


def test_what_an_update_writes_grows_with_the_change(spark, sf_dir, tmp_path):
    path = tmp_path / "store"
    s = GraphSession.open(spark, f"file://{path}", dataset(spark, sf_dir, ["orders"]).ontology)
    s.load(dataset(spark, sf_dir, ["orders", "customer"]).quads())
    whole = s.data.base.count()
    for k in range(12):  # deltas merge on the way
        s.update(f"INSERT OR REPLACE {{ <http://data/order/{k}> :orderstatus 'X{k}' }}")
    kept = sum(x.quads.count() for x in s.data.deltas)
    assert whole > 10_000 and kept <= 12 * 8 and len(s.data.deltas) <= 9
    assert s.data.base_path == GraphSession.open(spark, f"file://{path}").data.base_path
    got = rows(GraphSession.open(spark, f"file://{path}").query("SELECT ?s { ?o :orderstatus ?s FILTER STRSTARTS(?s, 'X') }"))
    assert sorted(got) == sorted((f"X{k}",) for k in range(12))


def test_graph_operations_over_deltas(spark):
    s = session(spark)
    s.update("INSERT DATA { GRAPH <urn:g> { <urn:ann> a t:Person ; t:note 'there' } }", "COPY <urn:g> TO <urn:h>", "INSERT DATA { GRAPH <urn:h> { <urn:ann> t:note 'more' } }", "MOVE <urn:h> TO <urn:i>")
    assert sorted(rows(s.query("SELECT ?g ?n { GRAPH ?g { <urn:ann> t:note ?n } }"))) == [("urn:g", "there"), ("urn:i", "more"), ("urn:i", "there")]
    assert sorted(rows(s.query("SELECT ?n { <urn:ann> t:note ?n }"))) == [("likes green tea",), ("more",), ("there",)]
    s.update("CLEAR GRAPH <urn:i>", "DROP GRAPH <urn:g>")
    assert rows(s.query("SELECT ?g ?n { GRAPH ?g { <urn:ann> t:note ?n } }")) == []
    assert "urn:i" in s.data.graphs and rows(s.query("SELECT ?n { <urn:ann> t:note ?n }")) == [("likes green tea",)]


TEXTS = ['<urn:a> a t:Person ; t:called "green tea house" ; t:note "the tea is green green" .', '<urn:b> a t:Person ; t:called "Tea" ; t:note "green, tea; house" , "and a house of tea" .', '<urn:c> a t:Person ; t:called "nothing here" .', '<urn:d> a t:Person ; t:note "greenhouse" .']
QUESTIONS = ["tea", "green tea", "gree", "house te", '"green tea"', '"tea is" gre', '"a house" "of tea"', "absent", "nothing he"]


@pytest.mark.parametrize("text", QUESTIONS)
def test_stored_postings_answer_as_the_scan_does(spark, text):
    scan, stored = _both(spark)
    q = f"SELECT ?x (ROUND(fts:rank(?x) * 100000) AS ?r) (fts:offsets(?x) AS ?o) {{ ?x fts:match '{text}' }}"
    assert sorted(rows(stored.query(q))) == sorted(rows(scan.query(q)))
    snippet = f"SELECT ?x (fts:snippet(?x, '<', '>') AS ?s) {{ ?x fts:match '{text}' }}"
    assert sorted(rows(stored.query(snippet))) == sorted(rows(scan.query(snippet)))


_cache: dict = {}


def _both(spark):
    if not _cache:
        scan, stored = (session(spark, PREFIX + "\n".join(TEXTS)) for _ in range(2))
        stored.index_texts()
        for s in (scan, stored):
            s.update("DELETE DATA { <urn:c> t:called 'nothing here' }", "INSERT DATA { <urn:e> a t:Person ; t:note 'tea, green' . <urn:c> t:note 'nothing here or there' }", "DELETE DATA { <urn:d> a rdfs:Resource }")
        assert stored.data.index is not None and stored.data.index.touched is not None
        _cache.update(scan=scan, stored=stored)
    return _cache["scan"], _cache["stored"]


def test_search_by_postings_reads_no_text(spark):
    _, stored = _both(spark)
    fresh = session(spark, PREFIX + "\n".join(TEXTS))
    fresh.index_texts()
    plan = fresh.query("SELECT ?x { ?x fts:match 'green te' }")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "Or(EqualTo(term,green),StringStartsWith(term,te))" in plan and "quads" not in plan
