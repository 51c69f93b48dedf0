"""Updates as new snapshots: both deltas come from one WHERE result.

The subjects that a change names are read with all their quads; these minus
what is deleted plus what is inserted are what the new snapshot holds of them,
everything else stays where it is. Types and super-properties propagate at
write time within the graph. Constraints are checked on the touched subjects'
quads before they are published; only a unique value is looked for elsewhere.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dataset import MOST_DELTAS, QUAD_SQL, ClassTable, Dataset, anonymous_name, digest
from .errors import ConstraintViolation, GraphError, ParseError, TypeMismatch, UnknownGraph, UnknownProperty
from .parser.ast import Update
from .plans.lower import Compiler, Scope
from .runtime import materialise, spread
from .terms import ROW, TERM, TERM_SQL, convert, equal, parse_datetime, to_lex, to_term
from .vocab import DEFAULT_GRAPH, ONT, RDF, RDFS

_KEY = ["g", "s", "p", "o"]


def apply(data: Dataset, u: Update, params: dict, services: dict) -> Dataset:
    """The snapshot after one update; the same one if a SILENT update fails."""
    try:
        return _apply(data, u, params, services)
    except GraphError:
        if u.silent:
            return data
        raise


def _apply(data: Dataset, u: Update, params: dict, services: dict) -> Dataset:
    if u.kind in ("insert_data", "delete_data", "modify"):
        return _modify(data, u, params, services)
    if u.kind == "load":
        from .sources.rdf import read_quads

        return inserted(data, read_quads(data.spark, u.source, u.target), implicit=True)
    if u.kind == "create":
        _allowed(u, u.target)
        if u.target in _graphs(data):
            raise UnknownGraph(f"{u.target} exists")
        if ":" not in u.target:
            raise ParseError(f"{u.target!r} is no IRI")
        return replace(data, graphs=data.graphs | {u.target})
    if u.kind in ("clear", "drop"):
        return _clear(data, u)
    return _copy(data, u)


def _allowed(u: Update, graph: str | None) -> None:
    g = graph or DEFAULT_GRAPH
    if u.allowed_graphs is not None and g not in {DEFAULT_GRAPH if x == "DEFAULT" else x for x in u.allowed_graphs}:
        raise ConstraintViolation(f"{g} is not among the allowed graphs")


def _graphs(data: Dataset) -> set[str]:
    """Names of the graphs; they are declared or few, so they come to the driver."""
    return {r[0] for r in data.named_graphs().collect()}


def _clear(data: Dataset, u: Update) -> Dataset:
    if u.target in ("ALL", "NAMED", "DEFAULT"):
        keep = {"ALL": lambda g: F.lit(False), "NAMED": lambda g: g == DEFAULT_GRAPH, "DEFAULT": lambda g: g != DEFAULT_GRAPH}[u.target]
        graphs = data.graphs if u.target == "DEFAULT" else frozenset(_graphs(data)) if u.kind == "clear" else frozenset()
    else:
        _allowed(u, u.target)
        if u.target not in _graphs(data):
            raise UnknownGraph(u.target)
        keep = lambda g: g != u.target
        graphs = data.graphs - {u.target} if u.kind == "drop" else data.graphs | {u.target}
    return data.kept(keep, graphs=graphs)


def _copy(data: Dataset, u: Update) -> Dataset:
    """ADD, COPY and MOVE: the subjects of both graphs are touched."""
    source, target = (DEFAULT_GRAPH if x == "DEFAULT" else x for x in (u.source, u.target))
    _allowed(u, target)
    if source == target:
        return data
    if source != DEFAULT_GRAPH and source not in _graphs(data):
        raise UnknownGraph(source)
    graphs = data.graphs | ({target} if target != DEFAULT_GRAPH else set())
    if u.kind == "move":
        graphs -= {source}
    every = data.quads().where(F.col("g").isin(source, target)).select("s")
    touched, path = data.write(spread(every, "s", every).distinct(), "touched")
    starts, _ = data.starts(touched)
    quads = data.about(touched, starts)
    moved = quads.where(F.col("g") == source).withColumn("g", F.lit(target)).select(*_KEY)
    if u.kind in ("copy", "move"):
        quads = quads.where(F.col("g") != target)
    if u.kind == "move":
        quads = quads.where(F.col("g") != source)
    quads = quads.union(moved)
    return data.changed(touched, path, starts, spread(quads, "s", quads).distinct(), graphs=graphs)


def _template(c: Compiler, sol, quads: list, graph: str | None, scope: Scope) -> DataFrame | None:
    """Quads of a template over solutions; rows with an unbound term are left out."""
    parts = []
    for s, p, o, g in quads:
        pred = ("iri", p[1]) if p[0] == "p" else p
        cols = [to_lex(*c.template_term(s, sol)).alias("s"), to_lex(*c.template_term(pred, sol)).alias("p")]
        null_object = o[0] == "null"
        cols.append((F.lit(None).cast(TERM_SQL) if null_object else to_term(*c.template_term(o, sol))).alias("o"))
        g = ("iri", graph or DEFAULT_GRAPH) if g is None else g
        cols.insert(0, to_lex(*c.template_term(g, sol)).alias("g"))
        part = sol.df.select(*cols).where("g is not null and s is not null and p is not null")
        parts.append(part if null_object else part.where("o is not null"))
    return spread(reduce(DataFrame.union, parts), "s", sol.df).distinct() if parts else None


def _modify(data: Dataset, u: Update, params: dict, services: dict) -> Dataset:
    for quads in (u.insert, u.delete):
        for _, p, _, g in quads:
            if p[0] == "p" and p[1] != RDF + "type":
                data.ontology.property_def(p[1])
            if g is None or g[0] == "iri":
                _allowed(u, g[1] if g else u.with_graph)
    c = Compiler(data, params, services)
    scope = Scope()
    if u.using or u.using_named:
        scope = Scope(frozenset(u.using), frozenset(u.using_named))
    elif u.with_graph:
        scope = Scope(frozenset([u.with_graph]))
    sol = c.group(u.where, scope) if u.where else c.unit()
    if u.where and (out := _changed_rows(data, u, c, sol, scope)) is not None:
        return out
    if u.where:
        sol.df = materialise(sol.df, "where")
    deleted, added = _template(c, sol, u.delete, u.with_graph, scope), _template(c, sol, u.insert, u.with_graph, scope)
    deleted, added = (x if x is None else materialise(x, "change") for x in (deleted, added))
    nulls = any(o[0] == "null" for _, _, o, _ in u.insert)
    known = all(p[0] == "p" for _, p, _, _ in u.insert)
    return _changed(data, deleted, added, u.replace, nulls=nulls, known=known)


def _rows_of(data: Dataset, u: Update, sol) -> list[ClassTable]:
    """The tables whose rows alone an update may change: one variable's single values, held as columns of their own."""
    onto, every = data.ontology, [*u.delete, *u.insert]
    if data.stored is not None or u.replace or u.with_graph not in (None, DEFAULT_GRAPH) or len({s for s, *_ in every}) != 1:
        return []
    s, props = every[0][0], {p[1] for _, p, _, _ in every}
    if s[0] != "var" or s[1] not in sol.vars or any(p[0] != "p" or o[0] == "null" or g is not None for _, p, o, g in every):
        return []
    t = sol.type(s[1])
    tables = [x for x in data.tables if (x.key is not None and x.prefix == t.prefix if t.kind == "key" else x.key is None)] if t.kind in ("key", "iri") else []
    if not tables or len(tables) > MOST_DELTAS or any(x.cls != tables[0].cls or x.graph is not None for x in tables):
        return []
    columns, up = tables[0].columns, onto.superclasses(tables[0].cls)
    for p in props:
        d = onto.properties.get(p)
        if d is None or p not in columns or columns[p][1].kind not in ("string", "integer", "double", "dateTime") or not d.single or d.unique or d.domain not in (*up, RDFS + "Resource"):
            return []
        if set(onto.superproperties(p)) & {x for q in columns if q != p for x in onto.superproperties(q)}:
            return []
    return tables


def _own_rows(data: Dataset, u: Update, c: Compiler, sol, scope: Scope, x: str, t: ClassTable) -> tuple | None:
    """Solutions with the rows of an anonymous table in place of their subject ``x``, and a condition on these rows.

    Only where one scan of the table binds ``x`` and nothing else tells of it: then the names of
    the rows that change are all that is ever hashed. Chance would tell equal rows apart.
    """
    own = [c.settled(y) for e in u.where if e[0] == "triples" for y in e[1] if y[0] == ("var", x)]
    once = sum(e[0] == "triples" and any(y[0] == ("var", x) for y in e[1]) for e in u.where) == 1
    if not once or repr(u.where).count(repr(x)) != len(own) or any(o == ("var", x) or o[0] == "bnode" for _, _, o, _ in (*u.delete, *u.insert)):
        return None
    if any(p[0] != "p" or p[1] not in data.ontology.properties and p[1] != RDF + "type" for _, p, _ in own) or not sol.df._jdf.queryExecution().analyzed().deterministic():
        return None
    inner = Compiler(data, c.params, c.services)
    inner.row = (x, t)
    sol = inner.group(u.where, scope)
    if x not in sol.vars or sol.type(x) != ROW:
        return None
    among = None
    for _, p, o in own:
        have = [q for q in t.columns if p[1] != RDF + "type" and q in data.ontology.subproperties(p[1])]
        if len(have) == 1 and o[0] == "lit" and t.columns[have[0]][1].kind in ("string", "integer", "double"):
            e, kind = t.columns[have[0]]
            same = equal(F.expr(e), kind, *c.constant(o))
            among = same if among is None else among & same
    return inner, sol, among


def _changed_rows(data: Dataset, u: Update, c: Compiler, sol, scope: Scope) -> Dataset | None:
    """The snapshot after an update that gives rows of class tables other values.

    The WHERE result is gathered by subject and meets the rows once, or brings
    them along, and the changed rows are written as rows. None where quads are needed after all:
    a subject lies in no such table, or a column would not give a value back as it was told.
    """
    tables = _rows_of(data, u, sol)
    if not tables:
        return None
    onto, first = data.ontology, tables[0]
    x = u.delete[0][0][1] if u.delete else u.insert[0][0][1]
    anonymous = first.key is None
    props = list(dict.fromkeys(p[1] for _, p, _, _ in (*u.delete, *u.insert)))
    brought = _own_rows(data, u, c, sol, scope, x, first) if anonymous and first.named is None and len(tables) == 1 else None
    c, sol, among = brought or (c, sol, None)
    told = lambda quads, p: [to_term(*c.template_term(o, sol)) for _, q, o, _ in quads if q[1] == p]
    sets = {f"{what}{k}": told(quads, p) for k, p in enumerate(props) for what, quads in (("less", u.delete), ("more", u.insert))}
    columns = [(name, j, term.alias(f"{name}_{j}")) for name, terms in sets.items() for j, term in enumerate(terms)]
    told_of = [sol.col(x)["id"].alias("_s"), sol.col(x)["row"].alias("_row")] if brought else [sol.col(x).alias("_s")]
    wanted = sol.df.select(*told_of, *(col for _, _, col in columns)).where("_s is not null")
    none = F.array().cast(f"array<{TERM_SQL}>")
    gathered = [reduce(F.array_union, (F.collect_set(f"{n}_{j}") for n, j, _ in columns if n == name), none).alias(name) for name in sets]
    wanted = wanted.groupBy("_s").agg(*([F.first("_row").alias("_row")] if brought else []), *gathered).where(" or ".join(f"size({name}) > 0" for name in sets))
    at = {p: f"c{k}" for k, p in enumerate(first.columns)}
    if brought:
        whole = wanted.select("_row.*", F.struct(*sets).alias("_sets"))
        own = whole.select(anonymous_name(first.df.columns).alias("_s"), *(F.expr(first.columns[p][0]).alias(n) for p, n in at.items()), "_sets")
        both = own.select("_s", *at.values(), "_sets.*", F.lit(True).alias("_here"))
    else:
        wanted, path = data.write(wanted, "touched")
        touched = wanted.select((F.col("_s") if anonymous else F.concat(F.lit(first.prefix), F.col("_s").cast("string"))).alias("s"))
        meet = digest(F.col("_s")) if anonymous else F.col("_s")
        rows = reduce(DataFrame.union, (t.df.select(t.subject()[0].alias("_s"), *(F.expr(t.columns[p][0]).alias(n) for p, n in at.items())) for t in tables))
        both = wanted.withColumn("_k", meet).join(rows.withColumn("_k", meet).drop("_s").withColumn("_here", F.lit(True)), "_k", "left")
    new, several, strange, lossy = {}, [], [], F.col("_here").isNull()
    for k, p in enumerate(props):
        t = first.columns[p][1]
        now, value = to_term(F.col(at[p]), t), F.get(f"_more{k}", F.lit(0))
        both = both.withColumn(f"_more{k}", F.array_distinct(F.transform(f"more{k}", _into(onto.properties[p].type.kind))))
        lost = F.coalesce(F.array_contains(f"less{k}", now), F.lit(False))
        left = F.array_compact(F.array_union(f"_more{k}", F.array(F.when(~lost, now))))
        several.append(F.when(F.size(left) > 1, F.struct(F.size(left).alias("n"), F.col("_s").cast("string").alias("s"), F.lit(p).alias("p"))))
        strange.append(F.when(F.exists(f"_more{k}", lambda o: o.isNull()), F.struct(F.col("_s").cast("string").alias("s"), F.lit(p).alias("p"))))
        back = convert(value, TERM, t)
        lossy = lossy | (value.isNotNull() & ~to_term(back, t).eqNullSafe(value))
        new[p] = F.when(value.isNotNull(), back).when(~lost, F.col(at[p]))
    out = both.select("_s", *(new.get(p, F.col(n)).alias(n) for p, n in at.items()), lossy.alias("_lossy"), F.coalesce(*strange).alias("_strange"), F.coalesce(*several).alias("_several"))
    out, written = data.write(out, "rows")
    if brought:
        path, touched = written, out.select(F.col("_s").alias("s"))
    found = out.agg(F.count("*").alias("n"), F.max("_lossy").alias("lossy"), F.any_value("_strange", F.lit(True)).alias("strange"), F.any_value("_several", F.lit(True)).alias("several")).first()
    name = lambda s: s if anonymous else first.prefix + s
    if found["n"] == 0:
        return data
    if found["lossy"]:
        return None
    if bad := found["strange"]:
        raise TypeMismatch(f"{name(bad['s'])} has a value outside the range of {bad['p']}")
    if bad := found["several"]:
        raise ConstraintViolation(f"{name(bad['s'])} has {bad['n']} values of {bad['p']}")
    own = {p: (n, first.columns[p][1]) for p, n in at.items()}
    table = ClassTable(first.cls, out.select("_s", *at.values()), first.prefix, None if anonymous else "_s", own, named="_s" if anonymous else None)
    return data.changed_rows(tables, table, touched, path, among)


def _changed(data: Dataset, deleted: DataFrame | None, added: DataFrame | None, replaces: bool = False, implicit: bool = False, nulls: bool = False, known: bool = False) -> Dataset:
    """The snapshot after a change, given as stored quads; ``known``: its properties are declared ones."""
    parts = [x.select("s") for x in (deleted, added) if x is not None]
    if not parts:
        return data
    touched, path = data.write(spread(reduce(DataFrame.union, parts), "s", *parts).distinct(), "touched")
    starts, some = data.starts(touched)
    if not some:
        return data
    quads, needed, graphs = data.about(touched, starts), None, data.graphs
    if data.tables or data.stored is not None:
        quads = materialise(quads, "before")
    if deleted is not None:
        graphs |= {r[0] for r in quads.select("g").where(F.col("g") != DEFAULT_GRAPH).distinct().collect()}
        quads = removed(data, quads, deleted)
    if added is not None:
        if nulls and not added.where("o is null").where(F.col("p") == RDF + "type").isEmpty():
            raise ConstraintViolation("NULL for rdf:type")
        if nulls or replaces:
            cleared = added if replaces else added.where("o is null")
            quads = quads.join(cleared.where(F.col("p") != RDF + "type").select("g", "s", "p").distinct(), ["g", "s", "p"], "left_anti").select(*_KEY)
        new, needed = widened(data, added.where("o is not null"), implicit, known)
        quads = spread(quads.unionByName(new), "s", quads, added).distinct()
    out = data.changed(touched, path, starts, quads, graphs=graphs)
    check(out, touched, None if implicit else needed)
    return out


def inserted(data: Dataset, quads: DataFrame, implicit: bool = False) -> Dataset:
    """With more quads; with ``implicit``, as for RDF documents, a subject gets
    the domain class of its properties; in updates a missing class is an error."""
    quads = quads.select(*_KEY).where("o is not null")
    return _changed(data, None, materialise(spread(quads, "s", quads), "added"), implicit=implicit)


def removed(data: Dataset, stored: DataFrame, quads: DataFrame) -> DataFrame:
    """``stored`` without some quads; a lost type takes its subclasses and dependent values along."""
    onto = data.ontology
    up = [(p, q) for p in onto.properties for q in onto.superproperties(p)]
    wider = data.spark.createDataFrame(up, "p string, q string")
    props = quads.where(F.col("p") != RDF + "type").join(F.broadcast(wider), "p").select("g", "s", F.col("q").alias("p"), "o")
    below = data.spark.createDataFrame([(c, d) for c in onto.classes for d in onto.classes if c in onto.superclasses(d)], "c string, d string")
    types = quads.where(F.col("p") == RDF + "type").select("g", "s", F.col("o.lex").alias("c")).join(F.broadcast(below), "c").select("g", "s", "d").distinct()
    domains = data.spark.createDataFrame([(p.iri, p.domain) for p in onto.properties.values()], "p string, d string")
    dependent = types.join(F.broadcast(domains), "d").select("g", "s", "p").distinct()
    lost_types = types.select("g", "s", F.lit(RDF + "type").alias("p"), F.struct(F.lit("iri").alias("kind"), F.col("d").alias("lex"), F.lit(None).cast("string").alias("lang")).alias("o"))
    left = _anti(stored, props.unionByName(lost_types))
    return left.join(dependent.where(F.col("p") != RDF + "type"), ["g", "s", "p"], "left_anti").select(*_KEY)


def _flat_key(df: DataFrame) -> DataFrame:
    return df.withColumn("_o", F.concat_ws("\x00", "o.kind", "o.lex", F.coalesce("o.lang", F.lit(""))))


def _anti(left: DataFrame, right: DataFrame) -> DataFrame:
    return _flat_key(left).join(_flat_key(right).select("g", "s", "p", "_o").distinct(), ["g", "s", "p", "_o"], "left_anti").select(*_KEY)


def widened(data: Dataset, quads: DataFrame, implicit: bool, checked: bool = False) -> tuple[DataFrame, DataFrame]:
    """New quads with super-types and super-properties, and the classes (g, s, c) that their properties need."""
    onto = data.ontology
    known = [*onto.properties, RDF + "type"]
    if not implicit and not checked:
        strange = quads.where(~F.col("p").isin(*known)).first()
        if strange:
            raise UnknownProperty(strange["p"])
    quads = quads.where(F.col("p").isin(*known))
    wider = data.spark.createDataFrame([(p, q, onto.properties[q].type.kind) for p in onto.properties for q in onto.superproperties(p)], "p string, q string, kind string")
    values = quads.where(F.col("p") != RDF + "type").join(F.broadcast(wider), "p").select("g", "s", F.col("q").alias("p"), _ranged(F.col("o"), F.col("kind")).alias("o"))
    strange = values.where("o is null").first() if not implicit else None
    if strange:
        raise TypeMismatch(f"{strange['s']} has a value outside the range of {strange['p']}")
    values = values.where("o is not null")
    up = data.spark.createDataFrame([(c, d) for c in onto.classes for d in onto.superclasses(c)], "c string, d string")
    types = quads.where(F.col("p") == RDF + "type").select("g", "s", F.col("o.lex").alias("c"))
    domains = data.spark.createDataFrame([(p.iri, p.domain) for p in onto.properties.values()], "p string, c string")
    needed = spread(values.join(F.broadcast(domains), "p").select("g", "s", "c").where(F.col("c") != RDFS + "Resource"), "s", quads).distinct()
    if implicit:
        types = types.union(needed)
    iri = F.struct(F.lit("iri").alias("kind"), F.col("d").alias("lex"), F.lit(None).cast("string").alias("lang"))
    types = types.join(F.broadcast(up), "c").select("g", "s", F.lit(RDF + "type").alias("p"), iri.alias("o"))
    return values.unionByName(types), needed


def _ranged(o, kind):
    """A value as its property's range has it; null where it cannot be.

    Text becomes a number, truth value or date; whole numbers become doubles;
    strings and tagged strings stay what they are.
    """
    k, lex = o["kind"], o["lex"]
    fits = (k == kind) | k.isin("iri", "bnode") & (kind == "iri") | k.isin("string", "lang") & kind.isin("string", "lang")
    read = (
        F.when(kind == "integer", F.coalesce(lex.try_cast("bigint"), F.when(lex.try_cast("double") == F.floor(lex.try_cast("double")), lex.try_cast("double").try_cast("bigint"))).cast("string"))
        .when(kind == "double", F.when(lex.try_cast("double").isNotNull(), lex))
        .when(kind == "boolean", F.when(F.lower(lex).isin("true", "1"), "true").when(F.lower(lex).isin("false", "0"), "false"))
        .when(kind == "date", F.when(F.substring(lex, 1, 10).try_cast("date").isNotNull(), F.substring(lex, 1, 10)))
        .when(kind == "dateTime", F.when(parse_datetime(lex).isNotNull(), lex))
        .when(kind.isin("string", "lang") & ~k.isin("iri", "bnode"), lex)
    )
    read = F.when(~k.isin("iri", "bnode"), read)
    return F.when(fits, o).when(read.isNotNull(), F.struct(kind.alias("kind"), read.alias("lex"), F.lit(None).cast("string").alias("lang")))


def _into(kind: str):
    return lambda o: _ranged(o, F.lit(kind))


def check(data: Dataset, touched: DataFrame, needed: DataFrame | None = None) -> None:
    """Raises where a touched subject has several values of a single-valued property,
    shares a unique value with any subject, or lacks a domain class."""
    onto = data.ontology
    q = data.deltas[-1].quads if data.deltas else data.stored
    if q is None:
        return
    single = [p.iri for p in onto.properties.values() if p.single and p.iri not in (ONT + "added", ONT + "modified")]
    unique = [p.iri for p in onto.properties.values() if p.unique]
    told = q.where(F.col("p").isin(*single))
    several = spread(told.select("g", "s", "p"), "s", q).groupBy("g", "s", "p").agg(F.count("*").alias("n")).where("n > 1").select("g", "s", "p")
    if not several.isEmpty() and (bad := told.join(several, ["g", "s", "p"], "left_semi").groupBy("g", "s", "p").agg(F.count_distinct("o").alias("n")).where("n > 1").first()):
        raise ConstraintViolation(f"{bad['s']} has {bad['n']} values of {bad['p']}")
    if unique:
        own = q.join(touched, "s", "left_semi").where(F.col("p").isin(*unique))
        if not own.isEmpty():
            every = data.quads(set(unique)).where(F.col("p").isin(*unique)).join(own.select("g", "p", F.col("o.lex").alias("_lex")).distinct().withColumnsRenamed({"g": "_g", "p": "_p"}), (F.col("g") == F.col("_g")) & (F.col("p") == F.col("_p")) & (F.col("o.lex") == F.col("_lex")), "left_semi")
            if bad := every.groupBy("g", "p", "o").agg(F.count_distinct("s").alias("n")).where("n > 1").first():
                raise ConstraintViolation(f"{bad['n']} subjects share a value of {bad['p']}")
    if needed is not None:
        have = q.where(F.col("p") == RDF + "type").select("g", "s", F.col("o.lex").alias("c"))
        if bad := needed.join(have, ["g", "s", "c"], "left_anti").first():
            raise ConstraintViolation(f"{bad['s']} is no {bad['c']}")


def evolved(data: Dataset, ontology, changes: list[tuple[str, str]]) -> Dataset:
    """Stored quads under a new ontology: ranges converted, removed elements dropped."""
    if data.stored is None:
        return replace(data, ontology=ontology)
    q = data.stored
    for what, iri in changes:
        if what == "remove property":
            q = q.where(F.col("p") != iri)
        elif what == "remove class":
            q = q.where(~((F.col("p") == RDF + "type") & (F.col("o.lex") == iri)))
        elif what == "change range":
            kind = ontology.properties[iri].type.kind
            lex = F.col("o.lex")
            cast = {"integer": F.coalesce(lex.try_cast("bigint"), lex.try_cast("double").try_cast("bigint")).cast("string"), "double": lex.try_cast("double").cast("string"), "boolean": F.when(F.lower(lex).isin("true", "1"), "true").otherwise("false")}.get(kind, lex)
            o = F.struct(F.lit(kind).alias("kind"), cast.alias("lex"), F.col("o.lang").alias("lang"))
            q = q.withColumn("o", F.when(F.col("p") == iri, o).otherwise(F.col("o"))).where("o.lex is not null")
    return replace(data, ontology=ontology).with_quads(*data.write(q.select(*_KEY), "quads"))
