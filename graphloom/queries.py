"""Registered queries, one for each operator family, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from .errors import GraphError
from .ontology import Ontology, PropertyDef
from .runtime import scratch_path
from .session import GraphSession, Options
from .sources.tables import GRAPHS, dataset, ontology
from .vocab import DATA, DEFAULT_GRAPH, ONT, RDF, RDFS, XSD

_ONTOLOGY = ontology()
#: The ontology's own triples as an SQL table (s, p, o), and how many properties take one value.
_SCHEMA = "(VALUES " + ", ".join(f"('{s}', '{p}', '{o}')" for s, p, _, o in _ONTOLOGY.triples()) + ") AS schema_rows(s, p, o)"
_SINGLE = sum(d.single for d in _ONTOLOGY.properties.values())

#: name: (tables read, SPARQL, SQL)
SIMPLE: dict[str, tuple[str, str, str]] = {
    "bgp_star": ("customer", "SELECT ?c ?n ?b { ?c a :Customer ; :name ?n ; :acctbal ?b ; :mktsegment 'BUILDING' }", "SELECT 'http://data/customer/' || c_custkey AS c, c_name AS n, c_acctbal AS b FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "bgp_chain": (
        "lineitem orders customer nation",
        "SELECT ?nname (SUM(?q) AS ?qty) (COUNT(?o) AS ?n) { ?l a :LineItem ; :order ?o ; :extendedprice ?price ; :quantity ?q . ?o :customer ?c . ?c :nation ?nat . ?nat :name ?nname FILTER (?price > 1000) } GROUP BY ?nname",
        "SELECT n_name AS nname, sum(l_quantity) AS qty, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_extendedprice > 1000 GROUP BY 1",
    ),
    "type_scan": ("part", "SELECT ?p { ?p a :Part }", "SELECT 'http://data/part/' || p_partkey AS p FROM part"),
    "subclass_scan": ("customer supplier", "SELECT ?x ?n { ?x a :Agent ; :name ?n }", "SELECT 'http://data/customer/' || c_custkey AS x, c_name AS n FROM customer UNION ALL SELECT 'http://data/supplier/' || s_suppkey, s_name FROM supplier"),
    "subproperty": ("region nation", "SELECT ?x ?l { ?x rdfs:label ?l }", "SELECT 'http://data/region/' || r_regionkey AS x, r_name AS l FROM region UNION ALL SELECT 'http://data/nation/' || n_nationkey, n_name FROM nation"),
    "constant_subject": ("nation region", "SELECT ?n ?r { <http://data/nation/3> :name ?n ; :region ?r }", "SELECT n_name AS n, 'http://data/region/' || n_regionkey AS r FROM nation WHERE n_nationkey = 3"),
    "constant_object": ("nation region", "SELECT ?x { ?x :region <http://data/region/2> }", "SELECT 'http://data/nation/' || n_nationkey AS x FROM nation WHERE n_regionkey = 2"),
    "filter_compare": ("part", "SELECT ?p ?s { ?p :size ?s ; :retailprice ?r FILTER (?s >= 10 && ?s < 20 || ?r > 1900) }", "SELECT 'http://data/part/' || p_partkey AS p, CAST(p_size AS BIGINT) AS s FROM part WHERE p_size >= 10 AND p_size < 20 OR p_retailprice > 1900"),
    "filter_in": ("orders", "SELECT ?o ?p { ?o :orderpriority ?p ; :orderstatus ?s FILTER (?p IN ('1-URGENT', '2-HIGH') && ?s NOT IN ('F')) }", "SELECT 'http://data/order/' || o_orderkey AS o, o_orderpriority AS p FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F')"),
    "filter_regex": ("nation", "SELECT ?n { ?x a :Nation ; :name ?n FILTER REGEX(?n, '^nation_1', 'i') }", "SELECT n_name AS n FROM nation WHERE regexp_matches(n_name, '^nation_1', 'i')"),
    "filter_not": ("customer", "SELECT ?n { ?c a :Customer ; :name ?n ; :mktsegment ?m FILTER (!(?m = 'BUILDING') && !STRSTARTS(?m, 'A')) }", "SELECT c_name AS n FROM customer WHERE NOT c_mktsegment = 'BUILDING' AND NOT starts_with(c_mktsegment, 'A')"),
    "join_cross": ("region", "SELECT ?a ?b { { ?x a :Region ; :name ?a } { ?y a :Region ; :name ?b } }", "SELECT x.r_name AS a, y.r_name AS b FROM region x, region y"),
    "join_theta": ("supplier", "SELECT ?a ?b { ?x a :Supplier ; :nation ?n ; :acctbal ?p ; :name ?a . ?y a :Supplier ; :nation ?n ; :acctbal ?q ; :name ?b FILTER (?p < ?q) }", "SELECT x.s_name AS a, y.s_name AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_acctbal < y.s_acctbal"),
    "blank_nodes": ("orders customer", "SELECT ?n { _:o :customer [ :name ?n ; :mktsegment 'MACHINERY' ] ; :orderstatus 'O' }", "SELECT c_name AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' AND o_orderstatus = 'O'"),
    "optional_left": ("documents labels", "SELECT ?d ?q { ?d a :Document OPTIONAL { ?l :document ?d ; :quality ?q } }", "SELECT 'http://data/document/' || d.doc_id AS d, CAST(quality AS BIGINT) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "optional_filter": ("documents labels", "SELECT ?d ?q { ?d a :Document ; :nChars ?c OPTIONAL { ?l :document ?d ; :quality ?q FILTER (?q = 1 && ?c > 500) } }", "SELECT 'http://data/document/' || d.doc_id AS d, CAST(quality AS BIGINT) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND quality = 1 AND n_chars > 500"),
    "optional_nested": ("documents labels", "SELECT ?d ?q ?t { ?d a :Document OPTIONAL { ?l :document ?d ; :quality ?q OPTIONAL { ?l :toxic ?t FILTER (?t = 1) } } }", "SELECT 'http://data/document/' || d.doc_id AS d, CAST(quality AS BIGINT) AS q, CAST(CASE WHEN toxic = 1 THEN 1 END AS BIGINT) AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "optional_unbound_join": ("documents labels", "SELECT ?d ?q { ?d a :Document OPTIONAL { ?l :document ?d ; :quality ?q } { SELECT ?q { VALUES ?q { 0 } } } }", "SELECT 'http://data/document/' || d.doc_id AS d, CAST(0 AS BIGINT) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 0 OR quality IS NULL"),
    "union_pad": ("customer supplier", "SELECT ?x ?seg ?bal { { ?x a :Customer ; :mktsegment ?seg } UNION { ?x a :Supplier ; :acctbal ?bal } }", "SELECT 'http://data/customer/' || c_custkey AS x, c_mktsegment AS seg, CAST(NULL AS DOUBLE) AS bal FROM customer UNION ALL SELECT 'http://data/supplier/' || s_suppkey, NULL, s_acctbal FROM supplier"),
    "minus_shared": ("customer orders", "SELECT ?c { ?c a :Customer MINUS { ?o :customer ?c ; :orderstatus 'F' } }", "SELECT 'http://data/customer/' || c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"),
    "minus_disjoint": ("region nation", "SELECT ?n { ?x a :Region ; :name ?n MINUS { ?y a :Nation ; :region ?z } }", "SELECT r_name AS n FROM region"),
    "exists": ("customer orders", "SELECT ?c { ?c a :Customer ; :acctbal ?b FILTER EXISTS { ?o :customer ?c ; :totalprice ?t FILTER (?t > ?b * 30) } }", "SELECT 'http://data/customer/' || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 30)"),
    "not_exists": ("customer orders", "SELECT ?c { ?c a :Customer FILTER NOT EXISTS { ?o :customer ?c ; :orderstatus 'P' ; :totalprice ?t FILTER (?t > 300000) } }", "SELECT 'http://data/customer/' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 300000)"),
    "exists_in_expression": ("customer orders", "SELECT ?c ?has { ?c a :Customer BIND (EXISTS { ?o :customer ?c ; :orderstatus 'P' } AS ?has) }", "SELECT 'http://data/customer/' || c_custkey AS c, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS has FROM customer"),
    "bind": ("part", "SELECT ?p ?d { ?p :size ?s BIND (?s * 2 + 1 AS ?d) FILTER (?d > 50) }", "SELECT 'http://data/part/' || p_partkey AS p, CAST(p_size * 2 + 1 AS BIGINT) AS d FROM part WHERE p_size * 2 + 1 > 50"),
    "values_one": ("nation", "SELECT ?n { VALUES ?x { <http://data/nation/1> <http://data/nation/7> } ?x :name ?n }", "SELECT n_name AS n FROM nation WHERE n_nationkey IN (1, 7)"),
    "values_many_undef": ("orders", "SELECT ?o ?s ?p { ?o :orderstatus ?s ; :orderpriority ?p VALUES (?s ?p) { ('F' UNDEF) ('O' '5-LOW') } }", "SELECT 'http://data/order/' || o_orderkey AS o, o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'O' AND o_orderpriority = '5-LOW'"),
    "values_after": ("orders", "SELECT ?o ?s { ?o :orderstatus ?s } VALUES ?s { 'P' }", "SELECT 'http://data/order/' || o_orderkey AS o, o_orderstatus AS s FROM orders WHERE o_orderstatus = 'P'"),
    "subselect": ("customer orders", "SELECT ?name ?n { ?c :name ?name { SELECT ?c (COUNT(?o) AS ?n) { ?o :customer ?c } GROUP BY ?c HAVING (COUNT(?o) > 12) } }", "SELECT c_name AS name, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12) ON c_custkey = o_custkey"),
    "scalar_subselect": ("customer", "SELECT ?c { ?c a :Customer ; :acctbal ?b FILTER (?b > (SELECT (AVG(?x) AS ?m) { ?y a :Customer ; :acctbal ?x })) }", "SELECT 'http://data/customer/' || c_custkey AS c FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)"),
    "distinct": ("orders", "SELECT DISTINCT ?s ?p { ?o :orderstatus ?s ; :orderpriority ?p }", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders"),
    "reduced": ("region", "SELECT REDUCED ?n { ?r a :Region ; :name ?n }", "SELECT r_name AS n FROM region"),
    "select_star": ("nation", "SELECT * { ?n a :Nation ; :region ?r }", "SELECT 'http://data/nation/' || n_nationkey AS n, 'http://data/region/' || n_regionkey AS r FROM nation"),
    "loose_select": ("region", "SELECT ?n STRLEN(?n) AS ?k { ?r a :Region ; :name ?n }", "SELECT r_name AS n, length(r_name) AS k FROM region"),
    "order_limit_offset": ("orders", "SELECT ?o ?t { ?o a :Order ; :totalprice ?t } ORDER BY DESC(?t) ?o LIMIT 20 OFFSET 5", "SELECT 'http://data/order/' || o_orderkey AS o, o_totalprice AS t FROM orders ORDER BY o_totalprice DESC, o LIMIT 20 OFFSET 5"),
    "order_expression": ("part", "SELECT ?p { ?p a :Part ; :size ?s ; :retailprice ?r } ORDER BY DESC(?s * 10000 + ?r) ?p LIMIT 7", "SELECT 'http://data/part/' || p_partkey AS p FROM part ORDER BY p_size * 10000 + p_retailprice DESC, p LIMIT 7"),
    "group_having": ("orders", "SELECT ?p (COUNT(*) AS ?n) (MAX(?t) AS ?top) { ?o :orderpriority ?p ; :totalprice ?t } GROUP BY ?p HAVING (COUNT(*) > 10) (MAX(?t) > 1)", "SELECT o_orderpriority AS p, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1 HAVING count(*) > 10 AND max(o_totalprice) > 1"),
    "group_expression": ("orders", "SELECT ?y (COUNT(?o) AS ?n) { ?o :orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1"),
    "agg_all": ("lineitem", "SELECT ?f (COUNT(*) AS ?n) (SUM(?q) AS ?s) (MIN(?q) AS ?lo) (MAX(?q) AS ?hi) (ROUND(AVG(?q) * 1000) AS ?m) { ?l :returnflag ?f ; :quantity ?q } GROUP BY ?f", "SELECT l_returnflag AS f, count(*) AS n, sum(l_quantity) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity) * 1000) AS m FROM lineitem GROUP BY 1"),
    "agg_distinct": ("lineitem", "SELECT ?f (COUNT(DISTINCT ?p) AS ?n) (SUM(DISTINCT ?k) AS ?s) (AVG(DISTINCT ?k) AS ?m) { ?l :returnflag ?f ; :part ?p ; :linenumber ?k } GROUP BY ?f", "SELECT l_returnflag AS f, count(DISTINCT l_partkey) AS n, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, avg(DISTINCT l_linenumber) AS m FROM lineitem GROUP BY 1"),
    "agg_implicit": ("customer", "SELECT (COUNT(?c) AS ?n) (SUM(?z) AS ?none) (GROUP_CONCAT(?z) AS ?empty) { ?c a :Customer }", "SELECT count(*) AS n, CAST(0 AS DOUBLE) AS none, '' AS empty FROM customer"),
    "agg_nested": ("region", "SELECT (STRLEN(GROUP_CONCAT(?n)) + COUNT(?n) AS ?k) { ?r a :Region ; :name ?n }", "SELECT CAST(length(string_agg(r_name, ',')) + count(*) AS BIGINT) AS k FROM region"),
    "group_concat": ("nation region", "SELECT ?r (GROUP_CONCAT(?n; SEPARATOR='|') AS ?all) (GROUP_CONCAT(DISTINCT ?n, '-') AS ?d) { ?x a :Nation ; :name ?n ; :region ?y . ?y :name ?r } GROUP BY ?r", "SELECT r_name AS r, string_agg(n_name, '|' ORDER BY n_name) AS \"all\", string_agg(DISTINCT n_name, '-' ORDER BY n_name) AS d FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "sample": ("nation region", "SELECT ?y (SAMPLE(?r) AS ?name) { ?x a :Nation ; :region ?y . ?y :name ?r } GROUP BY ?y", "SELECT 'http://data/region/' || r_regionkey AS y, r_name AS name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)"),
    "ask": ("region", "ASK { ?r :name 'EUROPE' }", "SELECT CASE WHEN count(*) > 0 THEN 'true' ELSE 'false' END AS result FROM region WHERE r_name = 'EUROPE'"),
    "construct": ("nation region", "CONSTRUCT { ?n :within ?r . ?r :holds ?n } WHERE { ?n a :Nation ; :region ?r }", f"SELECT 'http://data/nation/' || n_nationkey AS subject, '{DATA}within' AS predicate, 'http://data/region/' || n_regionkey AS object FROM nation UNION SELECT 'http://data/region/' || n_regionkey, '{DATA}holds', 'http://data/nation/' || n_nationkey FROM nation"),
    "construct_where": ("region", "CONSTRUCT WHERE { ?r a :Region ; :name ?n }", f"SELECT 'http://data/region/' || r_regionkey AS subject, '{DATA}name' AS predicate, r_name AS object FROM region UNION ALL SELECT 'http://data/region/' || r_regionkey, '{RDF}type', '{DATA}Region' FROM region"),
    "describe": (
        "region nation",
        "DESCRIBE ?n { ?n a :Nation ; :region <http://data/region/1> }",
        "SELECT s AS subject, p AS predicate, o AS object, '" + DEFAULT_GRAPH + f"' AS graph FROM (SELECT 'http://data/nation/' || n_nationkey AS s, unnest(['{RDF}type', '{RDF}type', '{DATA}name', '{RDFS}label', '{DATA}region']) AS p, unnest(['{DATA}Nation', '{RDFS}Resource', n_name, n_name, 'http://data/region/' || n_regionkey]) AS o FROM nation WHERE n_regionkey = 1)",
    ),
    "var_predicate": ("region nation", "SELECT ?s ?p ?o { ?s ?p ?o FILTER (?p != rdf:type) }", f"SELECT 'http://data/region/' || r_regionkey AS s, unnest(['{DATA}name', '{RDFS}label']) AS p, r_name AS o FROM region UNION ALL SELECT 'http://data/nation/' || n_nationkey, unnest(['{DATA}name', '{RDFS}label', '{DATA}region']), unnest([n_name, n_name, 'http://data/region/' || n_regionkey]) FROM nation UNION ALL SELECT s, p, o FROM {_SCHEMA} WHERE p <> '{RDF}type'"),
    "graph_iri": ("documents", f"SELECT ?d {{ GRAPH <{GRAPHS}src0> {{ ?d a :Document }} }}", "SELECT 'http://data/document/' || doc_id AS d FROM documents WHERE source = 'src0'"),
    "graph_var": ("documents", "SELECT ?g (COUNT(?d) AS ?n) { GRAPH ?g { ?d :lang 'en' } } GROUP BY ?g", f"SELECT '{GRAPHS}' || source AS g, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1"),
    "graph_union": ("documents", "SELECT ?l (COUNT(?d) AS ?n) { ?d :lang ?l } GROUP BY ?l", "SELECT lang AS l, count(*) AS n FROM documents GROUP BY 1"),
    "graph_names": ("documents region", "SELECT ?g { GRAPH ?g { } }", f"SELECT DISTINCT '{GRAPHS}' || source AS g FROM documents"),
    "from_default": ("documents", f"SELECT ?d FROM <{GRAPHS}src1> FROM <{GRAPHS}src2> {{ ?d a :Document }}", "SELECT 'http://data/document/' || doc_id AS d FROM documents WHERE source IN ('src1', 'src2')"),
    "from_named": ("documents", f"SELECT ?g ?d FROM NAMED <{GRAPHS}src3> {{ GRAPH ?g {{ ?d a :Document }} }}", f"SELECT '{GRAPHS}src3' AS g, 'http://data/document/' || doc_id AS d FROM documents WHERE source = 'src3'"),
    "constraint_graph": ("documents region", f"CONSTRAINT GRAPH <{GRAPHS}src4>, DEFAULT SELECT ?x {{ {{ ?x a :Document }} UNION {{ ?x a :Region }} }}", "SELECT 'http://data/document/' || doc_id AS x FROM documents WHERE source = 'src4' UNION ALL SELECT 'http://data/region/' || r_regionkey FROM region"),
    "path_inverse": ("nation region", "SELECT ?r ?n { ?r ^:region ?n }", "SELECT 'http://data/region/' || n_regionkey AS r, 'http://data/nation/' || n_nationkey AS n FROM nation"),
    "path_seq": ("orders customer nation region", "SELECT ?n (COUNT(?o) AS ?k) { ?o :customer/:nation/:region/:name ?n } GROUP BY ?n", "SELECT r_name AS n, count(*) AS k FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "path_alt": ("customer supplier nation", "SELECT ?x ?v { ?x (:mktsegment|:name) ?v . ?x a :Customer }", "SELECT 'http://data/customer/' || c_custkey AS x, unnest([c_mktsegment, c_name]) AS v FROM customer"),
    "path_opt": ("conversations", "SELECT ?u { <http://data/turn/0-0> :next? ?u }", "SELECT 'http://data/turn/0-0' AS u UNION SELECT 'http://data/turn/' || b.conv_id || '-' || b.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.conv_id = 0 AND a.turn = 0"),
    "path_plus": ("conversations", "SELECT ?t ?u { ?t :next+ ?u }", "WITH RECURSIVE e AS (SELECT a.conv_id || '-' || a.turn AS s, b.conv_id || '-' || b.turn AS o FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), r(s, o) AS (SELECT s, o FROM e UNION SELECT r.s, e.o FROM r JOIN e ON r.o = e.s) SELECT 'http://data/turn/' || s AS t, 'http://data/turn/' || o AS u FROM r"),
    "path_plus_bound": ("conversations", "SELECT ?u { <http://data/turn/1-0> :next+ ?u }", "SELECT 'http://data/turn/1-' || turn AS u FROM conversations WHERE conv_id = 1 AND turn > 0"),
    "path_star": ("conversations", "SELECT ?u { <http://data/turn/1-0> :next* ?u }", "SELECT 'http://data/turn/1-' || turn AS u FROM conversations WHERE conv_id = 1"),
    "path_neg": ("region nation", "SELECT ?s ?o { ?s !(rdf:type|:name|rdfs:label) ?o }", f"SELECT 'http://data/nation/' || n_nationkey AS s, 'http://data/region/' || n_regionkey AS o FROM nation UNION ALL SELECT s, o FROM {_SCHEMA} WHERE p <> '{RDF}type'"),
    "path_neg_inverse": ("region nation", "SELECT ?s ?o { ?s !(^rdf:type|^:name|^rdfs:label) ?o }", f"SELECT 'http://data/region/' || n_regionkey AS s, 'http://data/nation/' || n_nationkey AS o FROM nation UNION ALL SELECT o, s FROM {_SCHEMA} WHERE p <> '{RDF}type'"),
    "fn_string": (
        "part",
        "SELECT ?p (STRLEN(?n) AS ?a) (UCASE(?n) AS ?b) (LCASE(?y) AS ?c) (SUBSTR(?n, 2, 3) AS ?d) (SUBSTR(?n, 3) AS ?d2) (CONCAT(?n, '-', ?y) AS ?e) (CONTAINS(?y, 'EEL') AS ?f) (STRSTARTS(?y, 'S') AS ?g) (STRENDS(?y, 'L') AS ?h) (STRBEFORE(?n, '_') AS ?i) (STRAFTER(?n, '_') AS ?j) (REPLACE(?n, '([a-z])([0-9])', '$2$1') AS ?k) { ?p a :Part ; :name ?n ; :ptype ?y }",
        r"SELECT 'http://data/part/' || p_partkey AS p, length(p_name) AS a, upper(p_name) AS b, lower(p_type) AS c, substr(p_name, 2, 3) AS d, substr(p_name, 3) AS d2, p_name || '-' || p_type AS e, contains(p_type, 'EEL') AS f, starts_with(p_type, 'S') AS g, ends_with(p_type, 'L') AS h, CASE WHEN contains(p_name, '_') THEN split_part(p_name, '_', 1) ELSE '' END AS i, CASE WHEN contains(p_name, '_') THEN substr(p_name, instr(p_name, '_') + 1) ELSE '' END AS j, regexp_replace(p_name, '([a-z])([0-9])', '\2\1', 'g') AS k FROM part",
    ),
    "fn_string_join": ("nation", "SELECT ?x (fn:string-join((?n, ?none, 'z'), '+') AS ?j) (ENCODE_FOR_URI(CONCAT(?n, ' &/')) AS ?u) (gl:string-from-filename('/a/b_c.d.txt') AS ?f) { ?x a :Nation ; :name ?n }", "SELECT 'http://data/nation/' || n_nationkey AS x, n_name || '+z' AS j, n_name || '%20%26%2F' AS u, 'b c d' AS f FROM nation"),
    "fn_normalize": (
        "documents",
        "SELECT ?d (gl:case-fold(?h) AS ?a) (gl:unaccent(?h) AS ?b) (gl:ascii-lower-case(?h) AS ?c) (gl:strip-punctuation(?h) AS ?e) (gl:normalize(?h, 'nfc') AS ?f) (gl:title-order(?h) AS ?g) (gl:string-from-filename(CONCAT('/x/', ?l, '_', ?s, '.txt')) AS ?i) { ?d :text ?t ; :lang ?l ; :source ?s BIND (SUBSTR(?t, 1, 60) AS ?h) }",
        "SELECT 'http://data/document/' || doc_id AS d, replace(lower(h), 'ß', 'ss') AS a, strip_accents(h) AS b, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS c, regexp_replace(h, '\\p{P}', '', 'g') AS e, nfc_normalize(h) AS f, regexp_replace(lower(h), '^[\\p{P}\\s]*(?:(?:the|an|a)\\s+)?[\\p{P}\\s]*', '') AS g, lang || ' ' || source AS i FROM (SELECT *, substr(text, 1, 60) AS h FROM documents)",
    ),
    "fn_numeric": ("customer", "SELECT ?c (ABS(?b) AS ?a) (CEIL(?b) AS ?u) (FLOOR(?b) AS ?d) (ROUND(?b) AS ?r) (?b / 2 AS ?h) (3 / 2 AS ?q) (1 / 0 AS ?z) (-?b AS ?m) { ?c a :Customer ; :acctbal ?b }", "SELECT 'http://data/customer/' || c_custkey AS c, abs(c_acctbal) AS a, ceil(c_acctbal) AS u, floor(c_acctbal) AS d, round(c_acctbal) AS r, c_acctbal / 2 AS h, CAST(1.5 AS DOUBLE) AS q, CAST(NULL AS DOUBLE) AS z, -c_acctbal AS m FROM customer"),
    "fn_geo": (
        "part",
        "SELECT ?p (ROUND(gl:haversine-distance(?s, 20, ?r / 10, 40)) AS ?h) (ROUND(gl:cartesian-distance(?s, 20, ?r / 10, 40)) AS ?c) { ?p :size ?s ; :retailprice ?r }",
        "SELECT 'http://data/part/' || p_partkey AS p, round(2 * 6371000.0 * asin(sqrt(pow(sin((radians(20) - radians(p_size)) / 2), 2) + cos(radians(p_size)) * cos(radians(20)) * pow(sin((radians(40) - radians(p_retailprice / 10)) / 2), 2)))) AS h, round(6371000.0 * sqrt(pow(pi() / 2 - radians(p_size), 2) + pow(pi() / 2 - radians(20), 2) - 2 * (pi() / 2 - radians(p_size)) * (pi() / 2 - radians(20)) * cos(radians(40) - radians(p_retailprice / 10)))) AS c FROM part",
    ),
    "fn_hash": ("region", "SELECT ?n (MD5(?n) AS ?a) (SHA1(?n) AS ?b) (SHA256(?n) AS ?c) (STRLEN(SHA384(?n)) AS ?d) (STRLEN(SHA512(?n)) AS ?e) { ?r a :Region ; :name ?n }", "SELECT r_name AS n, md5(r_name) AS a, sha1(r_name) AS b, sha256(r_name) AS c, CAST(96 AS BIGINT) AS d, CAST(128 AS BIGINT) AS e FROM region"),
    "fn_date": ("orders", "SELECT ?o (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?k) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?i) (SECONDS(?d) AS ?s) (TZ(?d) AS ?z) (TIMEZONE(?d) AS ?t) { ?o :orderdate ?d FILTER (?d >= '1996-01-01T00:00:00Z'^^xsd:dateTime) }", "SELECT 'http://data/order/' || o_orderkey AS o, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS k, hour(o_orderdate) AS h, minute(o_orderdate) AS i, CAST(second(o_orderdate) AS DOUBLE) AS s, 'Z' AS z, 'PT0S' AS t FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'"),
    "fn_date_zone": ("region", "SELECT ?n (HOURS(?d) AS ?h) (TZ(?d) AS ?z) (TIMEZONE(?d) AS ?t) (fn:timezone-from-dateTime(?d) AS ?s) (?d = '2020-05-01T10:00:00Z'^^xsd:dateTime AS ?same) { ?r a :Region ; :name ?n BIND ('2020-05-01T12:00:00+02:00'^^xsd:dateTime AS ?d) }", "SELECT r_name AS n, CAST(12 AS BIGINT) AS h, '+02:00' AS z, 'PT2H' AS t, CAST(7200 AS BIGINT) AS s, TRUE AS same FROM region"),
    "fn_uri": ("region", "SELECT ?r (STR(?r) AS ?s) (isIRI(?r) AS ?a) (isLiteral(?n) AS ?b) (isNumeric(?n) AS ?c) (isBlank(?r) AS ?d) (gl:uri-is-parent('http://data/region', STR(?r)) AS ?e) (gl:uri-is-descendant('http://data', STR(?r)) AS ?f) (IRI(CONCAT('urn:x:', ?n)) AS ?g) { ?r a :Region ; :name ?n }", "SELECT 'http://data/region/' || r_regionkey AS r, 'http://data/region/' || r_regionkey AS s, TRUE AS a, TRUE AS b, FALSE AS c, FALSE AS d, TRUE AS e, TRUE AS f, replace('urn:x:' || r_name, ' ', '%20') AS g FROM region"),
    "fn_control": ("part", "SELECT ?p (IF(?s > 25, 'big', 'small') AS ?a) (COALESCE(?none, ?s, 1) AS ?b) (BOUND(?none) AS ?c) (sameTerm(?s, ?s) AS ?d) { ?p :size ?s }", "SELECT 'http://data/part/' || p_partkey AS p, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS a, CAST(p_size AS BIGINT) AS b, FALSE AS c, TRUE AS d FROM part"),
    "fn_cast": ("part", "SELECT ?p (xsd:integer(?r) AS ?i) (xsd:double(?s) AS ?d) (xsd:string(?s) AS ?t) (xsd:integer(?n) AS ?bad) (STRDT('12', xsd:integer) AS ?k) (DATATYPE(?s) AS ?dt) { ?p :size ?s ; :retailprice ?r ; :name ?n }", "SELECT 'http://data/part/' || p_partkey AS p, CAST(trunc(p_retailprice) AS BIGINT) AS i, CAST(p_size AS DOUBLE) AS d, CAST(p_size AS VARCHAR) AS t, TRY_CAST(p_name AS BIGINT) AS bad, CAST(12 AS BIGINT) AS k, 'http://www.w3.org/2001/XMLSchema#integer' AS dt FROM part"),
    "fn_lang": ("region", "SELECT ?n (LANG(?l) AS ?a) (LANGMATCHES(LANG(?l), 'en') AS ?b) (LANGMATCHES(LANG(?l), '*') AS ?c) (LANG(?n) AS ?d) (?l = 'x'@en AS ?e) { ?r a :Region ; :name ?n BIND (STRLANG(?n, 'en-GB') AS ?l) }", "SELECT r_name AS n, 'en-gb' AS a, TRUE AS b, TRUE AS c, '' AS d, FALSE AS e FROM region"),
    "property_function": ("nation region", "SELECT ?n (:name(?r) AS ?rn) (:name(:region(?n)) AS ?again) { ?n a :Nation ; :region ?r }", "SELECT 'http://data/nation/' || n_nationkey AS n, r_name AS rn, r_name AS again FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "fts_match": ("documents", "SELECT ?d { ?d fts:match 'than idiot' } ", "SELECT 'http://data/document/' || doc_id AS d FROM (SELECT doc_id, string_split_regex(lower(text), '[^\\p{L}\\p{N}]+') AS w FROM documents) WHERE list_contains(w, 'than') AND len(list_filter(w, lambda x: starts_with(x, 'idiot'))) > 0"),
    "fts_prefix": ("documents", "SELECT ?d { ?d fts:match 'the tion' }", "SELECT 'http://data/document/' || doc_id AS d FROM (SELECT doc_id, string_split_regex(lower(text), '[^\\p{L}\\p{N}]+') AS w FROM documents) WHERE list_contains(w, 'the') AND len(list_filter(w, lambda x: starts_with(x, 'tion'))) > 0"),
    "fts_phrase": ("documents", "SELECT ?d { ?d fts:match '\"of the\"' }", "SELECT 'http://data/document/' || doc_id AS d FROM (SELECT doc_id, ' ' || array_to_string(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') || ' ' AS t FROM documents) WHERE contains(t, ' of the ')"),
    "fts_rank": (
        "documents",
        "SELECT ?d (ROUND(fts:rank(?d) * 1000) AS ?r) { ?d fts:match 'the of' }",
        "WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: starts_with(x, 'of'))) AS b FROM w), s AS (SELECT count(*) AS k, avg(n) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM c) SELECT 'http://data/document/' || doc_id AS d, round(1000 * (ln(1 + (k - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / m)) + ln(1 + (k - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / m)))) AS r FROM c, s WHERE a > 0 AND b > 0",
    ),
    "fts_offsets": ("documents", "SELECT ?d (fts:offsets(?d) AS ?o) { ?d fts:match 'idiot' }", "SELECT 'http://data/document/' || doc_id AS d, array_to_string(list_transform(list_filter(range(len(w)), lambda i: starts_with(w[i + 1], 'idiot')), lambda i: 'text,' || i), ',') AS o FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents) WHERE len(list_filter(w, lambda x: starts_with(x, 'idiot'))) > 0"),
    "fts_snippet": (
        "documents",
        "SELECT ?d (fts:snippet(?d, '[', ']', '~', 3) AS ?s) { ?d fts:match 'idiot' }",
        "WITH r AS (SELECT doc_id, string_split_regex(text, '\\s+') AS r FROM documents), h AS (SELECT doc_id, r, list_transform(r, lambda x: len(list_filter(string_split_regex(lower(x), '[^\\p{L}\\p{N}]+'), lambda w: starts_with(w, 'idiot'))) > 0) AS h FROM r), p AS (SELECT *, greatest(list_position(h, true) - 1, 1) AS k FROM h WHERE list_contains(h, true)) SELECT 'http://data/document/' || doc_id AS d, CASE WHEN k > 1 THEN '~' ELSE '' END || array_to_string(list_transform(range(k, least(k + 3, len(r) + 1)), lambda i: CASE WHEN h[i] THEN '[' || r[i] || ']' ELSE r[i] END), ' ') || CASE WHEN k + 3 <= len(r) THEN '~' ELSE '' END AS s FROM p",
    ),
    "fn_uri_lookup": ("nation region", "SELECT ?n ?r { ?n a :Nation ; :region ?x BIND (gl:uri(gl:id(?x)) AS ?r) }", "SELECT 'http://data/nation/' || n_nationkey AS n, 'http://data/region/' || n_regionkey AS r FROM nation"),
    "fn_title_order": ("region", "SELECT ?n ?k { ?r a :Region ; :name ?n BIND (gl:title-order(CONCAT(IF(STRLEN(?n) > 5, '\"The ', 'A '), ?n)) AS ?k) } ORDER BY ?k", "SELECT r_name AS n, lower(r_name) AS k FROM region"),
    "order_collation": ("nation", "SELECT ?n { ?x a :Nation ; :name ?n } ORDER BY DESC(?n)", "SELECT n_name AS n FROM nation"),
    "group_mixed": ("nation region", "SELECT ?o (COUNT(?s) AS ?n) { ?s ?p ?o FILTER (?p IN (rdfs:label, :region)) } GROUP BY ?o", "SELECT o, count(*) AS n FROM (SELECT r_name AS o FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT 'http://data/region/' || n_regionkey FROM nation) GROUP BY 1"),
    "construct_typed": ("nation", "CONSTRUCT { ?n :size ?k ; a :Nation } WHERE { ?n a :Nation ; :name ?x BIND (STRLEN(?x) AS ?k) }", f"SELECT 'http://data/nation/' || n_nationkey AS subject, unnest(['{DATA}size', '{RDF}type']) AS predicate, unnest([CAST(length(n_name) AS VARCHAR), '{DATA}Nation']) AS object FROM nation"),
    "path_nested": ("nation region customer", "SELECT ?r (COUNT(?c) AS ?n) { ?r ^:region/^:nation ?c . ?c a :Customer } GROUP BY ?r", "SELECT 'http://data/region/' || n_regionkey AS r, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "fn_random": ("region", "SELECT ?r (RAND() >= 0 AS ?a) (STRLEN(STRUUID()) AS ?b) (STRSTARTS(STR(UUID()), 'urn:uuid:') AS ?c) (isBlank(BNODE()) AS ?d) (YEAR(NOW()) > 2000 AS ?e) { ?r a :Region }", "SELECT 'http://data/region/' || r_regionkey AS r, TRUE AS a, CAST(36 AS BIGINT) AS b, TRUE AS c, TRUE AS d, TRUE AS e FROM region"),
    "order_mixed": ("part", "SELECT ?p (xsd:double(?v) AS ?d) { ?p ?q ?v FILTER (?q IN (:size, :retailprice)) } ORDER BY DESC(?v) ?p LIMIT 90", "SELECT 'http://data/part/' || p_partkey AS p, d FROM (SELECT p_partkey, unnest([CAST(p_size AS DOUBLE), p_retailprice]) AS d FROM part) ORDER BY d DESC, p LIMIT 90"),
    "minmax_mixed": ("part labels", "SELECT ?q (MIN(?v) AS ?lo) (MAX(?v) AS ?hi) (SUM(?v) > 10 AS ?sum) { ?p ?q ?v FILTER (?q IN (:size, :retailprice, :quality)) } GROUP BY ?q", f"SELECT q, lo, hi, sum FROM (SELECT '{DATA}size' AS q, CAST(min(p_size) AS VARCHAR) AS lo, CAST(max(p_size) AS VARCHAR) AS hi, sum(p_size) > 10 AS sum FROM part UNION ALL SELECT '{DATA}retailprice', CAST(min(p_retailprice) AS VARCHAR), CAST(max(p_retailprice) AS VARCHAR), sum(p_retailprice) > 10 FROM part UNION ALL SELECT '{DATA}quality', CAST(min(quality) AS VARCHAR), CAST(max(quality) AS VARCHAR), sum(quality) > 10 FROM labels)"),
    "compare_mixed": ("part", "SELECT ?p ?a ?b { ?p ?q ?v ; ?r ?w FILTER (?q = :size && ?r = :retailprice && ?v < ?w) BIND (xsd:double(?w) > 950 AS ?a) BIND (?v >= ?w AS ?b) }", "SELECT 'http://data/part/' || p_partkey AS p, p_retailprice > 950 AS a, FALSE AS b FROM part WHERE p_size < p_retailprice"),
    "compare_terms": ("labels", "SELECT ?l { ?l ?q ?v ; ?r ?w FILTER (?q = :quality && ?r = :toxic && ?v > ?w) }", "SELECT 'http://data/label/' || doc_id AS l FROM labels WHERE quality > toxic"),
    "path_alt_mixed": ("part", "SELECT ?p ?v (DATATYPE(?v) = xsd:integer AS ?w) { ?p (:size|:retailprice) ?v }", "SELECT 'http://data/part/' || p_partkey AS p, unnest([CAST(p_size AS VARCHAR), CAST(p_retailprice AS VARCHAR)]) AS v, unnest([TRUE, FALSE]) AS w FROM part"),
    "distinct_mixed": ("part", "SELECT DISTINCT ?v { { ?p :size ?v } UNION { ?q :retailprice ?v } }", "SELECT DISTINCT CAST(p_size AS VARCHAR) AS v FROM part UNION SELECT CAST(p_retailprice AS VARCHAR) FROM part"),
    "exists_correlated": ("customer orders", "SELECT ?c { ?c a :Customer ; :acctbal ?b FILTER (EXISTS { ?o :customer ?c ; :totalprice ?t FILTER (?t > ?b * 30) } || ?b < 0) }", "SELECT 'http://data/customer/' || c_custkey AS c FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 30)"),
    "minus_optional": ("documents labels", "SELECT ?d ?q { ?d a :Document OPTIONAL { ?l :document ?d ; :quality ?q } MINUS { ?m :toxic ?q ; :quality 1 } }", "SELECT 'http://data/document/' || d.doc_id AS d, CAST(quality AS BIGINT) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NULL OR quality NOT IN (SELECT toxic FROM labels WHERE quality = 1)"),
    "prologue": ("region nation", "BASE <http://data/> PREFIX d: <onto#> SELECT ?x ?n { ?x d:region <region/1> ; d:name ?n }", "SELECT 'http://data/nation/' || n_nationkey AS x, n_name AS n FROM nation WHERE n_regionkey = 1"),
    "signed_literals": ("part", "SELECT ?p (?s -1 AS ?a) (?s +2 AS ?b) (-3 + ?s * -2 AS ?c) (+?r AS ?d) (gl:coalesce(?none, ?s) AS ?e) { ?p :size ?s ; :retailprice ?r }", "SELECT 'http://data/part/' || p_partkey AS p, CAST(p_size - 1 AS BIGINT) AS a, CAST(p_size + 2 AS BIGINT) AS b, CAST(-3 + p_size * -2 AS BIGINT) AS c, p_retailprice AS d, CAST(p_size AS BIGINT) AS e FROM part"),
    "schema_domain": ("region nation customer", "SELECT ?s ?p ?v { ?s ?p ?v . ?p rdfs:domain :Nation }", f"SELECT 'http://data/nation/' || n_nationkey AS s, '{DATA}region' AS p, 'http://data/region/' || n_regionkey AS v FROM nation"),
    "schema_subclass": ("customer supplier", "SELECT ?x ?n { ?x a ?c ; :name ?n . ?c rdfs:subClassOf :Agent }", "SELECT 'http://data/customer/' || c_custkey AS x, c_name AS n FROM customer UNION ALL SELECT 'http://data/supplier/' || s_suppkey, s_name FROM supplier"),
    "schema_type": ("part", "SELECT ?p ?v { ?x ?p ?v . ?p a rdf:Property ; rdfs:range xsd:integer }", f"SELECT '{DATA}size' AS p, CAST(p_size AS VARCHAR) AS v FROM part UNION ALL SELECT '{ONT}maxCardinality', '1' FROM (SELECT unnest(range({_SINGLE})))"),
    "path_opt_all": ("conversations", "SELECT ?t ?u { ?t a :Turn . ?t :next? ?u }", "SELECT 'http://data/turn/' || a.conv_id || '-' || a.turn AS t, 'http://data/turn/' || b.conv_id || '-' || b.turn AS u FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn AND a.turn + 1"),
    "path_star_all": ("conversations", "SELECT ?t ?u { ?t a :Turn . ?t :next* ?u }", "WITH RECURSIVE e AS (SELECT a.conv_id || '-' || a.turn AS s, b.conv_id || '-' || b.turn AS o FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), r(s, o) AS (SELECT conv_id || '-' || turn, conv_id || '-' || turn FROM conversations UNION SELECT r.s, e.o FROM r JOIN e ON r.o = e.s) SELECT 'http://data/turn/' || s AS t, 'http://data/turn/' || o AS u FROM r"),
    "path_neg_both": ("region nation", "SELECT ?s ?o { ?s !(rdf:type|:name|rdfs:label|^rdf:type|^:name|^rdfs:label) ?o FILTER (STRSTARTS(STR(?s), 'http://data/n') || STRSTARTS(STR(?s), 'http://data/r')) }", "SELECT 'http://data/nation/' || n_nationkey AS s, 'http://data/region/' || n_regionkey AS o FROM nation UNION ALL SELECT 'http://data/region/' || n_regionkey, 'http://data/nation/' || n_nationkey FROM nation"),
    "fts_two_matches": (
        "documents benchmark",
        "SELECT ?d (fts:offsets(?d) AS ?o) ?e (fts:offsets(?e) AS ?p) { ?d a :Document ; fts:match 'idiot' . ?e a :BenchmarkItem ; fts:match 'than' }",
        "WITH x AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents), y AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS v FROM benchmark) SELECT 'http://data/document/' || doc_id AS d, array_to_string(list_transform(list_filter(range(len(w)), lambda i: starts_with(w[i + 1], 'idiot')), lambda i: 'text,' || i), ',') AS o, 'http://data/item/' || item_id AS e, array_to_string(list_transform(list_filter(range(len(v)), lambda i: starts_with(v[i + 1], 'than')), lambda i: 'content,' || i), ',') AS p FROM x, y WHERE len(list_filter(w, lambda x: starts_with(x, 'idiot'))) > 0 AND len(list_filter(v, lambda x: starts_with(x, 'than'))) > 0",
    ),
}


def _simple(tables: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: GraphSession(spark, dataset(spark, d, tables.split())).query(text)


def _updated(tables: str, updates: list[str], text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        session = GraphSession(spark, dataset(spark, d, tables.split()))
        session.update(*updates)
        return session.query(text)

    return run


def service(spark: SparkSession, d: str) -> DataFrame:
    remote = dataset(spark, d, ["region"])
    session = GraphSession(spark, dataset(spark, d, ["nation"]), services={"urn:remote": remote})
    return session.query("SELECT ?n ?r { ?x a :Nation ; :name ?n ; :region ?y SERVICE <urn:remote> { ?y :name ?r } }")


def parameters(spark: SparkSession, d: str) -> DataFrame:
    s = GraphSession(spark, dataset(spark, d, ["orders"])).prepare("SELECT ?o { ?o :orderstatus ~status ; :totalprice ?t FILTER (?t > ~least) } ORDER BY ?t ?o LIMIT ~n")
    return s.bind(status="F", least=1000.0, n=25).execute()


def notifier(spark: SparkSession, d: str) -> DataFrame:
    from .streaming.notifier import changes

    session = GraphSession(spark, dataset(spark, d, ["customer"]))
    before = session.data
    session.update(
        "DELETE DATA { <http://data/customer/2> a :Customer } ; INSERT DATA { <http://data/customer/new> a :Customer ; :name 'New' } ; "
        "DELETE { ?c :acctbal ?b } INSERT { ?c :acctbal 1.5 } WHERE { ?c :mktsegment 'BUILDING' ; :acctbal ?b }"
    )
    return changes(before, session.data)


def fts_index(spark: SparkSession, d: str) -> DataFrame:
    """The postings of all indexed texts, as they would be stored."""
    from .operators.fts import index
    from .plans.lower import Scope

    return index(GraphSession(spark, dataset(spark, d, ["benchmark", "documents"])).compiler(), Scope())


def fts_stored(spark: SparkSession, d: str) -> DataFrame:
    """Rank by stored postings, kept right by updates: one text changes, one goes, one is new."""
    session = GraphSession(spark, dataset(spark, d, ["benchmark"]))
    session.index_texts()
    session.update(
        "DELETE { ?i :content ?t } INSERT { ?i :content 'than and than again' } WHERE { VALUES ?i { <http://data/item/3> } ?i :content ?t } ; "
        "DELETE DATA { <http://data/item/5> a rdfs:Resource } ; INSERT DATA { <http://data/item/new> a :BenchmarkItem ; :content 'more than that' }"
    )
    return session.query("SELECT ?i (ROUND(fts:rank(?i) * 1000) AS ?r) (fts:offsets(?i) AS ?o) { ?i fts:match 'than th' }")


def load(spark: SparkSession, d: str) -> DataFrame:
    """Tables written as documents, and those loaded into a graph of an empty session."""
    path = scratch_path(spark, "documents")
    GraphSession(spark, dataset(spark, d, ["nation", "region"])).export(path)
    session = GraphSession(spark, ontology())
    session.update(f"LOAD <{path}> INTO GRAPH <urn:loaded>")
    return session.query("SELECT ?g ?n ?r { GRAPH ?g { ?x a :Nation ; :name ?n ; :region ?y . ?y rdfs:label ?r } }")


def _documents(fmt: str) -> Callable[[SparkSession, str], DataFrame]:
    """The nations written as one document and read again."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        from .sources.rdf import parse, to_frame

        session = GraphSession(spark, dataset(spark, d, ["nation"]))
        text = session.serialize("DESCRIBE ?n { ?n a :Nation }", fmt)
        return to_frame(spark, parse(text, fmt)).selectExpr("s", "p", "o.lex as o")

    return run


def _results(fmt: str) -> Callable[[SparkSession, str], DataFrame]:
    """A result written as one document and read again."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        from .sources import results

        session = GraphSession(spark, dataset(spark, d, ["part"]))
        path = scratch_path(spark, "results")
        session.write_results(path, "SELECT ?p ?n ?s ?none { ?p :name ?n ; :size ?s }", fmt)
        return results.read(spark, path, fmt)

    return run


def evolution(spark: SparkSession, d: str) -> DataFrame:
    """Stored whole numbers become doubles under a changed ontology with one more property."""
    session = GraphSession(spark, dataset(spark, d, ["part"]).flattened())
    changed = [replace(p, range=XSD + "double") if p.iri == DATA + "size" else p for p in _ONTOLOGY.properties.values()]
    session.evolve(Ontology.of(_ONTOLOGY.classes.values(), [*changed, PropertyDef(DATA + "colour", DATA + "Part", XSD + "string")]))
    session.update("INSERT { ?p :colour 'red' } WHERE { ?p :size ?s FILTER (?s < 10) }")
    return session.query("SELECT ?p ?s ?c (DATATYPE(?s) AS ?t) { ?p a :Part ; :size ?s OPTIONAL { ?p :colour ?c } }")


def store(spark: SparkSession, d: str) -> DataFrame:
    """Tables put into a durable store, changed, and read by a session that opens its folder."""
    path = scratch_path(spark, "store")
    session = GraphSession.open(spark, path, ontology())
    session.load(dataset(spark, d, ["nation", "region", "customer"]).quads())
    session.update("DELETE { ?c :acctbal ?b } INSERT { ?c :acctbal 0.5 } WHERE { ?c :mktsegment 'BUILDING' ; :acctbal ?b }", "DELETE DATA { <http://data/customer/1> a rdfs:Resource }")
    return GraphSession.open(spark, path).query("SELECT ?c ?n ?b { ?c :nation/:name ?n ; :acctbal ?b }")


def batch(spark: SparkSession, d: str) -> DataFrame:
    """Resources, updates and parameters published as one snapshot."""
    from .resource import Resource

    session = GraphSession(spark, dataset(spark, d, ["orders"]))
    steps = session.batch().add_update("INSERT OR REPLACE { ?o :orderstatus ~status } WHERE { ?o :orderstatus 'P' ; :totalprice ?t FILTER (?t > ~least) }", status="X", least=250000.0)
    new = Resource("http://data/order/new").a(DATA + "Order").set(DATA + "orderstatus", "N")
    steps.add_resource(new).execute()
    return session.query("SELECT ?s (COUNT(?o) AS ?n) { ?o a :Order ; :orderstatus ?s } GROUP BY ?s")


def service_http(spark: SparkSession, d: str) -> DataFrame:
    """SERVICE over HTTP; the endpoint lets queries see the default graph only."""
    from .endpoint import Endpoint, Remote

    served = Endpoint(GraphSession(spark, dataset(spark, d, ["region", "documents"])), graphs=["DEFAULT"])
    try:
        session = GraphSession(spark, dataset(spark, d, ["nation"]), services={"urn:remote": Remote(served.url)})
        return session.query("SELECT ?n ?r { ?x a :Nation ; :name ?n ; :region ?y SERVICE <urn:remote> { { ?y :name ?r } UNION { ?y a :Document } } }")
    finally:
        served.close()


def errors(spark: SparkSession, d: str) -> DataFrame:
    """The kind of error that each of some wrong texts raises."""
    session = GraphSession(spark, dataset(spark, d, ["region"]))
    read_only = GraphSession(spark, dataset(spark, d, ["region"]), options=Options(read_only=True))
    texts = {
        "syntax": lambda: session.query("SELECT ?x {"),
        "function": lambda: session.query("SELECT (gl:nothing(1) AS ?x) { }"),
        "property": lambda: session.query("SELECT ?x { ?x :nothing 1 }"),
        "class": lambda: session.query("SELECT ?x { ?x a :Nothing }"),
        "graph": lambda: session.update("DROP GRAPH <urn:none>"),
        "cardinality": lambda: session.update("INSERT { ?r :name 'Two' } WHERE { ?r a :Region }"),
        "read-only": lambda: read_only.update("CLEAR DEFAULT"),
        "parameter": lambda: session.query("SELECT ?x { ?x :name ~n }"),
    }
    out = []
    for name, run in texts.items():
        try:
            run()
            out.append((name, "none"))
        except GraphError as e:
            out.append((name, type(e).__name__))
    return spark.createDataFrame(out, "what string, error string")


_N = "'http://data/nation/' || n_nationkey"
UPDATES: dict[str, tuple[str, list[str], str, str]] = {
    "insert_data": ("region", ["INSERT DATA { <http://data/region/99> a :Region ; :name 'NEW' } ; INSERT DATA { <http://data/region/99> a :Region }"], "SELECT ?r ?n { ?r a :Region ; :name ?n }", "SELECT 'http://data/region/' || r_regionkey AS r, r_name AS n FROM region UNION ALL SELECT 'http://data/region/99', 'NEW'"),
    "delete_data": ("region", ["DELETE DATA { <http://data/region/1> :name 'AMERICA' } ; DELETE DATA { <http://data/region/2> :name 'nothing' }"], "SELECT ?r ?n { ?r a :Region OPTIONAL { ?r :name ?n } }", "SELECT 'http://data/region/' || r_regionkey AS r, CASE WHEN r_regionkey = 1 AND r_name = 'AMERICA' THEN NULL ELSE r_name END AS n FROM region"),
    "delete_where": ("nation region", ["DELETE WHERE { ?n a :Nation ; :region <http://data/region/0> ; :name ?x }"], "SELECT ?n ?x { ?n a :Nation ; :name ?x }", f"SELECT {_N} AS n, n_name AS x FROM nation WHERE n_regionkey <> 0"),
    "modify": ("nation region", ["DELETE { ?n :name ?x } INSERT { ?n :name ?y } WHERE { ?n a :Nation ; :name ?x ; :region <http://data/region/3> BIND (CONCAT(?x, '!') AS ?y) }"], "SELECT ?n ?x { ?n a :Nation ; :name ?x }", f"SELECT {_N} AS n, CASE WHEN n_regionkey = 3 THEN n_name || '!' ELSE n_name END AS x FROM nation"),
    "insert_or_replace": ("region", ["INSERT OR REPLACE { <http://data/region/0> :name 'ZERO' } ; INSERT DATA { <http://data/region/1> :name NULL }"], "SELECT ?r ?n { ?r a :Region ; :name ?n }", "SELECT 'http://data/region/' || r_regionkey AS r, CASE WHEN r_regionkey = 0 THEN 'ZERO' ELSE r_name END AS n FROM region WHERE r_regionkey <> 1"),
    "type_deletion": ("region", ["DELETE DATA { <http://data/region/4> a rdfs:Resource }"], "SELECT ?r ?p { ?r ?p ?o }", f"SELECT 'http://data/region/' || r_regionkey AS r, unnest(['{RDF}type', '{RDF}type', '{DATA}name', '{RDFS}label']) AS p FROM region WHERE r_regionkey <> 4 UNION ALL SELECT s, p FROM {_SCHEMA}"),
    "graph_insert": ("region", ["INSERT DATA { GRAPH <urn:g1> { <urn:a> a :Region ; :name 'A' } GRAPH <urn:g2> { <urn:a> a :Region ; :name 'A' } }"], "SELECT ?g ?n { GRAPH ?g { ?x :name ?n } }", "SELECT unnest(['urn:g1', 'urn:g2']) AS g, 'A' AS n"),
    "graph_union_set": ("region", ["INSERT DATA { GRAPH <urn:g1> { <urn:a> a :Region ; :name 'A' } GRAPH <urn:g2> { <urn:a> a :Region ; :name 'A' } }"], "SELECT ?x ?n { ?x :name ?n }", "SELECT 'http://data/region/' || r_regionkey AS x, r_name AS n FROM region UNION ALL SELECT 'urn:a', 'A'"),
    "graph_copy": ("region", ["CREATE GRAPH <urn:g1> ; COPY DEFAULT TO <urn:g1> ; ADD <urn:g1> TO <urn:g2> ; MOVE <urn:g1> TO <urn:g3> ; CLEAR DEFAULT ; DROP SILENT GRAPH <urn:none>"], "SELECT ?g (COUNT(?x) AS ?n) { GRAPH ?g { ?x a :Region } } GROUP BY ?g", "SELECT g, count(*) AS n FROM region, (SELECT unnest(['urn:g2', 'urn:g3']) AS g) GROUP BY 1"),
    "list_expansion": ("region", ["INSERT DATA { <urn:x> a rdf:List ; rdf:first <http://data/region/1> ; rdf:rest <urn:y> . <urn:y> a rdf:List ; rdf:first <http://data/region/2> ; rdf:rest rdf:nil }"], "SELECT ?a ?b { ?l rdf:first ?x ; rdf:rest [ rdf:first ?y ; rdf:rest () ] . ?x :name ?a . ?y :name ?b }", "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b WHERE a.r_regionkey = 1 AND b.r_regionkey = 2"),
    "cardinality": ("orders", ["INSERT SILENT { ?o :orderstatus 'X' } WHERE { ?o :orderstatus 'P' }", "INSERT { ?o :orderstatus 'F' } WHERE { ?o :orderstatus 'F' }"], "SELECT ?s (COUNT(?o) AS ?n) { ?o :orderstatus ?s } GROUP BY ?s", "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1"),
    "modify_orders": ("orders customer", ["DELETE { ?o :orderpriority ?p } INSERT { ?o :orderpriority '0-NOW' } WHERE { ?o :orderstatus 'P' ; :orderpriority ?p ; :totalprice ?t FILTER (?t > 400000) }", "DELETE WHERE { ?o a :Order ; :orderstatus 'F' ; :orderpriority '5-LOW' ; :totalprice ?t ; :orderdate ?d }"], "SELECT ?p ?m (COUNT(?o) AS ?n) (SUM(?t) > 0 AS ?s) { ?o :orderpriority ?p ; :totalprice ?t ; :customer ?c . ?c :mktsegment ?m } GROUP BY ?p ?m", "SELECT CASE WHEN o_orderstatus = 'P' AND o_totalprice > 400000 THEN '0-NOW' ELSE o_orderpriority END AS p, c_mktsegment AS m, count(*) AS n, sum(o_totalprice) > 0 AS s FROM orders JOIN customer ON o_custkey = c_custkey WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '5-LOW') GROUP BY 1, 2"),
    "delete_lines": ("lineitem orders", ["DELETE { ?l :quantity ?q } INSERT { ?l :quantity 0.5 } WHERE { ?l :returnflag 'R' ; :quantity ?q ; :order ?o . ?o :orderstatus 'O' }"], "SELECT ?f (COUNT(?l) AS ?n) (SUM(?q) AS ?s) { ?l :returnflag ?f ; :quantity ?q } GROUP BY ?f", "SELECT l_returnflag AS f, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' AND o_orderstatus = 'O' THEN 0.5 ELSE l_quantity END) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"),
    "collections": ("region", ["INSERT DATA { <urn:x> a rdf:List ; rdf:first <http://data/region/0> ; rdf:rest <urn:y> . <urn:y> a rdf:List ; rdf:first <http://data/region/3> ; rdf:rest <urn:z> . <urn:z> a rdf:List ; rdf:first <http://data/region/4> ; rdf:rest rdf:nil }"], "SELECT ?h ?a ?b { ?h rdf:first ?f ; rdf:rest (?x ?y) . ?x :name ?a . ?y :name ?b FILTER NOT EXISTS { ?f :name 'nobody' } }", "SELECT 'urn:x' AS h, a.r_name AS a, b.r_name AS b FROM region a, region b WHERE a.r_regionkey = 3 AND b.r_regionkey = 4"),
    "path_cycle": ("nation region", ["INSERT DATA { <urn:a> a rdf:List ; rdf:rest <urn:b> . <urn:b> a rdf:List ; rdf:rest <urn:c> . <urn:c> a rdf:List ; rdf:rest <urn:a> }"], "SELECT ?x ?y { ?x rdf:rest+ ?y }", "SELECT x, y FROM (SELECT unnest(['urn:a', 'urn:b', 'urn:c']) AS x), (SELECT unnest(['urn:a', 'urn:b', 'urn:c']) AS y)"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _simple(tables, text) for name, (tables, text, _) in SIMPLE.items()}
QUERIES |= {name: _updated(tables, ups, text) for name, (tables, ups, text, _) in UPDATES.items()}
QUERIES |= {"service": service, "parameters": parameters, "notifier": notifier, "fts_index": fts_index, "fts_stored": fts_stored, "load": load, "evolution": evolution, "store": store, "batch": batch, "service_http": service_http, "errors": errors}
QUERIES |= {f"document_{name}": _documents(fmt) for name, fmt in (("turtle", "turtle"), ("trig", "trig"), ("jsonld", "json-ld"))}
QUERIES |= {f"results_{fmt}": _results(fmt) for fmt in ("json", "xml")}

ORACLE_SQL: dict[str, str] = {name: sql for name, (_, _, sql) in SIMPLE.items()}
ORACLE_SQL |= {name: sql for name, (_, _, _, sql) in UPDATES.items()}
ORACLE_SQL |= {
    "fts_index": f"SELECT term, s, '{DATA}' || prop AS prop, count(*) AS tf, any_value(length) AS length FROM (SELECT s, prop, len(w) AS length, unnest(w) AS term FROM (SELECT s, prop, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM (SELECT 'http://data/item/' || item_id AS s, 'content' AS prop, text FROM benchmark UNION ALL SELECT 'http://data/document/' || doc_id, 'text', text FROM documents))) GROUP BY 1, 2, 3",
    "fts_stored": "WITH b AS (SELECT 'http://data/item/' || item_id AS i, CASE WHEN item_id = 3 THEN 'than and than again' ELSE text END AS text FROM benchmark WHERE item_id <> 5 UNION ALL SELECT 'http://data/item/new', 'more than that'), w AS (SELECT i, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM b), c AS (SELECT i, w, len(w) AS n, 2 * len(list_filter(w, lambda x: x = 'than')) AS a, 2 * len(list_filter(w, lambda x: starts_with(x, 'th'))) AS b FROM w), s AS (SELECT count(*) AS k, avg(n) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM c) SELECT i, round(1000 * (ln(1 + (k - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / m)) + ln(1 + (k - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / m)))) AS r, array_to_string(list_transform(list_filter(range(n), lambda j: starts_with(w[j + 1], 'th')), lambda j: 'content,' || j), ',') AS o FROM c, s WHERE a > 0 AND b > 0",
    "load": "SELECT 'urn:loaded' AS g, n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey",
    "evolution": f"SELECT 'http://data/part/' || p_partkey AS p, CAST(p_size AS DOUBLE) AS s, CASE WHEN p_size < 10 THEN 'red' END AS c, '{XSD}double' AS t FROM part",
    "store": "SELECT 'http://data/customer/' || c_custkey AS c, n_name AS n, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.5 ELSE c_acctbal END AS b FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey <> 1",
    "batch": "SELECT CASE WHEN o_orderstatus = 'P' AND o_totalprice > 250000 THEN 'X' ELSE o_orderstatus END AS s, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'N', 1",
    "service_http": "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey",
    "errors": "SELECT * FROM (VALUES ('syntax', 'ParseError'), ('function', 'ParseError'), ('property', 'UnknownProperty'), ('class', 'UnknownClass'), ('graph', 'UnknownGraph'), ('cardinality', 'ConstraintViolation'), ('read-only', 'QueryFailed'), ('parameter', 'QueryFailed')) v(what, error)",
    "service": "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey",
    "parameters": "SELECT 'http://data/order/' || o_orderkey AS o FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 ORDER BY o_totalprice, o LIMIT 25",
    "notifier": f"SELECT CASE WHEN c_custkey = 2 THEN 'DELETE' ELSE 'UPDATE' END AS event, '{DEFAULT_GRAPH}' AS graph, 'http://data/customer/' || c_custkey AS resource FROM customer WHERE c_custkey = 2 OR c_mktsegment = 'BUILDING' AND c_acctbal <> 1.5 UNION ALL SELECT 'CREATE', '{DEFAULT_GRAPH}', 'http://data/customer/new'",
}
_DOCUMENT = f"SELECT 'http://data/nation/' || n_nationkey AS s, unnest(['{RDF}type', '{RDF}type', '{DATA}name', '{RDFS}label', '{DATA}region']) AS p, unnest(['{DATA}Nation', '{RDFS}Resource', n_name, n_name, 'http://data/region/' || n_regionkey]) AS o FROM nation"
ORACLE_SQL |= {f"document_{name}": _DOCUMENT for name in ("turtle", "trig", "jsonld")}
ORACLE_SQL |= {f"results_{fmt}": "SELECT 'http://data/part/' || p_partkey AS p, p_name AS n, CAST(p_size AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS none FROM part" for fmt in ("json", "xml")}
