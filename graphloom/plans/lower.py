"""From syntax tree to DataFrame plans.

Triples on one subject that a class table holds become one scan; scans meet in
equi joins on raw keys, and IRIs are made only in the final projection. The
rest is left to Catalyst and adaptive execution.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dataset import ClassTable, Dataset
from ..errors import ParseError, QueryFailed, Unsupported
from ..functions import builtins
from ..ontology import SCHEMA_CLASSES, SCHEMA_PROPERTIES
from ..operators import fts, paths
from ..parser.ast import Query
from ..terms import BOOLEAN, DOUBLE, INTEGER, IRI, NULL, ROW, STRING, TERM, T, common, convert, equal, less, literal, merged, null, order_key, to_lex, to_term, truth
from ..vocab import DEFAULT_GRAPH, FN, FTS, GL, RDF, XSD
from .solutions import Sol, blocked, flagged, fresh, join, minus, semi, union


@dataclass(frozen=True)
class Scope:
    """Graphs in view. None means no restriction; ``graph`` is the one of GRAPH."""

    default: frozenset[str] | None = None
    named: frozenset[str] | None = None
    allowed: frozenset[str] | None = None
    graph: tuple | None = None

    def condition(self, g: Column) -> Column | None:
        if self.graph is None:
            names = self.default
        elif self.graph[0] == "iri":
            if self.named is not None and self.graph[1] not in self.named:
                return F.lit(False)
            names = frozenset([self.graph[1]])
        else:
            names = self.named
        if names is not None and self.allowed is not None:
            names = names & self.allowed
        elif names is None:
            names = self.allowed
        cond = None
        if names is not None:
            cond = g.isin(*sorted(names)) if names else F.lit(False)
        if self.graph is not None and self.graph[0] == "var":
            named = g != DEFAULT_GRAPH
            if self.named is not None:
                return cond
            cond = named if cond is None else cond & named
        return cond

    @property
    def unrestricted(self) -> bool:
        return self == Scope()

    @property
    def several(self) -> bool:
        """Whether the same triple may be seen in more than one graph."""
        names = self.default if self.graph is None else None
        return self.graph is None and (names is None or len(names) > 1)


class Compiler:
    def __init__(self, dataset: Dataset, params: dict | None = None, services: dict | None = None, anonymous: bool = False):
        self.data, self.spark, self.onto = dataset, dataset.spark, dataset.ontology
        self.params, self.services = params or {}, services or {}
        self.anonymous = anonymous
        #: Keeps the blank nodes of two runs of one template apart.
        self.salt = uuid.uuid4().hex
        self.allowed_services: frozenset[str] | None = None
        #: Prefixes that a bound variable's IRIs surely have, so that only their tables are read.
        self.hints: dict[str, set[str]] = {}
        self.uses: dict[str, int] | None = None
        #: Texts that each subject variable is matched with.
        self.matches: dict[str, list[str]] = {}
        self.calls: dict[str, list] = {}
        #: A subject variable and the table whose rows it stands for.
        self.row: tuple[str, ClassTable] | None = None

    # -- whole queries

    def scope_of(self, q: Query) -> Scope:
        allowed = None if q.allowed_graphs is None else frozenset(DEFAULT_GRAPH if g == "DEFAULT" else g for g in q.allowed_graphs)
        self.allowed_services = None if q.allowed_services is None else frozenset(q.allowed_services)
        if q.from_default or q.from_named:
            return Scope(frozenset(q.from_default), frozenset(q.from_named), allowed)
        return Scope(allowed=allowed)

    def run(self, q: Query) -> DataFrame:
        scope = self.scope_of(q)
        self.uses = None if q.star else _uses(q)
        self.calls = _fts_calls(q)
        if q.form == "select":
            sol, names = self.select(q, scope)
            return self.final(sol, names)
        if q.form == "ask":
            return self.group(q.where, scope).df.limit(1).agg(F.when(F.count("*") > 0, "true").otherwise("false").alias("result"))
        if q.form == "construct":
            return self.construct(q, scope)
        return self.describe(q, scope)

    def final(self, sol: Sol, names: list[str]) -> DataFrame:
        return sol.df.select(*(self.printed(sol.col(v), sol.type(v)).alias(v) for v in names))

    def printed(self, c: Column, t: T) -> Column:
        if self.anonymous and t.kind in ("iri", "term"):
            node = t.kind == "iri"
            is_blank = F.startswith(to_lex(c, t), F.lit("urn:bnode:")) & (F.lit(True) if node else c["kind"].isin("iri", "bnode"))
            return F.when(is_blank, F.concat(F.lit("_:"), F.substr(to_lex(c, t), F.lit(11)))).otherwise(to_lex(c, t))
        return c if t.kind in ("integer", "double", "boolean", "date", "string", "iri") else to_lex(c, t)

    def modified(self, q: Query, sol: Sol) -> Sol:
        """Solutions with the modifiers of a query form without a projection."""
        if q.order_by:
            sol = Sol(sol.df.orderBy(*self.order_keys(q, sol)), sol.vars, sol.bound)
        return self.sliced(q, sol)

    def sliced(self, q: Query, sol: Sol) -> Sol:
        df = sol.df
        if q.offset is not None:
            df = df.offset(self.number(q.offset))
        if q.limit is not None:
            df = df.limit(self.number(q.limit))
        return Sol(df, sol.vars, sol.bound)

    def number(self, x) -> int:
        return int(self.param(x[1])) if isinstance(x, tuple) else x

    def param(self, name: str):
        if name not in self.params:
            raise QueryFailed(f"parameter ~{name} has no value")
        return self.params[name]

    def graph_rows(self, q: Query) -> DataFrame:
        """A CONSTRUCT's or DESCRIBE's triples as quads with typed objects."""
        scope = self.scope_of(q)
        self.uses = None if q.star else _uses(q)
        if q.form == "describe":
            return self.described(q, scope).select("g", "s", "p", "o")
        parts = [part.select(F.lit(DEFAULT_GRAPH).alias("g"), F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o")) for part in self.constructed(q, scope, to_term)]
        return reduce(DataFrame.union, parts).distinct()

    def construct(self, q: Query, scope: Scope) -> DataFrame:
        return reduce(DataFrame.union, self.constructed(q, scope, to_lex)).distinct()

    def constructed(self, q: Query, scope: Scope, told) -> list[DataFrame]:
        sol = self.modified(q, self.group(q.where, scope))
        parts = []
        for s, p, o, _ in (t if len(t) == 4 else (*t, None) for t in q.template):
            cols = []
            for term, name in ((s, "subject"), (p[1:] and (("iri", p[1]) if p[0] == "p" else p), "predicate"), (o, "object")):
                c, t = self.template_term(term, sol)
                cols.append((told if name == "object" else to_lex)(c, t).alias(name))
            part = sol.df.select(*cols)
            parts.append(part.where(F.col("subject").isNotNull() & F.col("predicate").isNotNull() & F.col("object").isNotNull()).distinct())
        return parts

    def template_term(self, term, sol: Sol) -> tuple[Column, T]:
        if term[0] == "bnode":
            every = [F.coalesce(to_lex(sol.col(v), sol.type(v)), F.lit("\x00")) for v in sorted(sol.vars)]
            return F.concat(F.lit("urn:bnode:"), F.md5(F.concat_ws("\x01", F.lit(self.salt + term[1]), *every))), IRI
        return self.term(term, sol)

    def describe(self, q: Query, scope: Scope) -> DataFrame:
        return self.described(q, scope).select(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o.lex").alias("object"), F.col("g").alias("graph"))

    def described(self, q: Query, scope: Scope) -> DataFrame:
        subjects = []
        sol = self.modified(q, self.group(q.where, scope)) if q.where else None
        for r in q.resources:
            if r[0] == "iri":
                subjects.append(self.spark.createDataFrame([(r[1],)], "s string"))
            elif sol is not None and r[1] in sol.vars:
                subjects.append(sol.df.select(to_lex(sol.col(r[1]), sol.type(r[1])).alias("s")))
        if q.star and sol is not None:
            subjects += [sol.df.select(to_lex(sol.col(v), sol.type(v)).alias("s")) for v in sol.vars if sol.type(v).resource or sol.type(v) is TERM]
        if not subjects:
            raise ParseError("nothing to describe")
        wanted = reduce(DataFrame.union, subjects).where("s is not null").distinct()
        rows = self.quads(replace(scope, graph=None))
        return rows.join(wanted, "s", "left_semi")

    def select(self, q: Query, scope: Scope) -> tuple[Sol, list[str]]:
        outer, self.hints = self.hints, {}
        if q.star:
            self.uses = None
        sol = self.group(q.where, scope)
        self.hints = outer
        if q.values:
            sol = join(sol, self.values(*q.values))
        items = [(("term", ("var", v)), v) for v in sol.vars if not v.startswith(".")] if q.star else q.items
        if q.star and not items:
            raise ParseError("SELECT * without a variable")
        grouped = bool(q.group_by) or any(_has_agg(e) for e, _ in items) or any(_has_agg(e) for e in q.having) or any(_has_agg(e) for e, _ in q.order_by)
        having, order = list(q.having), list(q.order_by)
        if grouped:
            sol, items, having, order = self.grouped(q, sol, items, having, order, scope)
        names: list[str] = []
        for k, (e, name) in enumerate(items):
            if name is None:
                name = e[1][1] if e[0] == "term" and e[1][0] == "var" else f"_{k}"
            if e == ("term", ("var", name)):
                if name not in sol.vars:
                    sol = sol.extend(name, null(), NULL)
            else:
                e, sol = self.with_scalars(e, sol, scope)
                c, t = self.expr(e, sol, scope)
                sol = sol.extend(name, c, t)
            names.append(name)
        for e in having:
            e, sol = self.with_scalars(e, sol, scope)
            c, t = self.expr(e, sol, scope)
            sol = sol.where(truth(c, t))
        if order:
            for k, (e, down) in enumerate(order):
                e, sol = self.with_scalars(e, sol, scope)
                order[k] = (e, down)
            keys = self.order_keys(replace(q, order_by=order), sol)
            if q.distinct:
                sol = self.distinct(sol, names)
                keys = self.order_keys(replace(q, order_by=order), sol)
            sol = Sol(sol.df.orderBy(*keys), sol.vars, sol.bound)
        elif q.distinct:
            sol = self.distinct(sol, names)
        return self.sliced(q, sol.keep(names)), names

    @staticmethod
    def distinct(sol: Sol, names: list[str]) -> Sol:
        out = sol.keep(names)
        return Sol(out.df.distinct(), out.vars, out.bound)

    def order_keys(self, q: Query, sol: Sol) -> list[Column]:
        keys = []
        for e, down in q.order_by:
            c, t = self.expr(e, sol, Scope())
            if t.kind == "term":
                k = order_key(c)
                parts = [k["rank"], k["number"], k["whole"], k["at"], F.collate(k["text"], "UNICODE")]
                keys += [x.desc_nulls_last() if down else x.asc_nulls_first() for x in parts]
                continue
            if t.kind in ("string", "lang"):
                c = F.collate(to_lex(c, t), "UNICODE")
            elif t.kind == "key":
                c = to_lex(c, t)
            elif t.kind == "dateTime":
                c = c["ts"]
            keys.append(c.desc_nulls_last() if down else c.asc_nulls_first())
        return keys

    # -- aggregates

    def grouped(self, q: Query, sol: Sol, items, having, order, scope: Scope):
        """Group, aggregate, and rewrite expressions over the results."""
        keys: list[tuple[str, object]] = []
        for e, name in q.group_by:
            name = name or f".key{len(keys)}"
            if e != ("term", ("var", name)):
                c, t = self.expr(e, sol, scope)
                sol = sol.extend(name, c, t)
            elif name not in sol.vars:
                sol = sol.extend(name, null(), NULL)
            keys.append((name, e))
        aggs: dict[tuple, str] = {}

        def rewrite(e):
            for name, key in keys:
                if e == key and e[0] != "term":
                    return ("term", ("var", name))
            if isinstance(e, tuple) and e and e[0] == "agg":
                k = _frozen(e)
                aggs.setdefault(k, f".agg{len(aggs)}")
                return ("term", ("var", aggs[k]))
            if isinstance(e, tuple):
                return tuple(rewrite(x) for x in e)
            if isinstance(e, list):
                return [rewrite(x) for x in e]
            return e

        original: dict[str, tuple] = {}

        def collect(e):
            if isinstance(e, tuple) and e and e[0] == "agg":
                original[_frozen(e)] = e
            if isinstance(e, (tuple, list)):
                for x in e:
                    collect(x)

        for e in [*(e for e, _ in items), *having, *(e for e, _ in order)]:
            collect(e)
        items = [(rewrite(e), n) for e, n in items]
        having = [rewrite(e) for e in having]
        order = [(rewrite(e), d) for e, d in order]
        exprs, types = [], {}
        for k, name in aggs.items():
            c, t = self.aggregate(original[k], sol, scope)
            column = fresh("agg")
            exprs.append(c.alias(column))
            types[name] = (column, t)
        loose = {v for e, _ in items for v in _vars(e)} - {n for n, _ in keys} - set(types)
        for v in sorted(loose):
            if v in sol.vars:  # neither grouped nor aggregated: any value of the group
                column = fresh(v)
                exprs.append(F.any_value(sol.col(v), F.lit(True)).alias(column))
                types[v] = (column, sol.type(v))
        out, by = {}, []
        for name, _ in keys:
            column = fresh("key")
            by.append(sol.col(name).alias(column))
            out[name] = (column, sol.type(name))
        exprs = exprs or [F.count("*").alias(fresh("n"))]
        df = sol.df.groupBy(*by).agg(*exprs) if by else sol.df.agg(*exprs)
        return Sol(df, out | types, sol.bound & set(out)), items, having, order

    def aggregate(self, e, sol: Sol, scope: Scope) -> tuple[Column, T]:
        _, name, distinct, arg, sep = e
        if arg == "*":
            if distinct:
                every = [F.coalesce(to_lex(sol.col(v), sol.type(v)), F.lit("\x00")) for v in sol.vars]
                return F.count_distinct(F.concat_ws("\x01", *every)), INTEGER
            return F.count("*"), INTEGER
        c, t = self.expr(arg, sol, scope)
        if name == "COUNT":
            return (F.count_distinct(merged(c, t)) if distinct else F.count(c)), INTEGER
        if name == "SUM" and t is TERM:
            return self.term_sum(c, distinct), TERM
        if name in ("SUM", "AVG"):
            n = c if t.numeric else convert(c, t, DOUBLE) if t is TERM else null(DOUBLE)
            kind = t if t.numeric else DOUBLE
            if name == "SUM":
                zero = F.lit(0).cast("bigint") if kind is INTEGER else F.lit(0.0)
                return F.coalesce(F.sum_distinct(n) if distinct else F.sum(n), zero), kind
            mean = F.try_divide(F.sum_distinct(n).cast("double"), F.count_distinct(n)) if distinct else F.avg(n)
            return F.coalesce(mean, F.lit(0.0)), DOUBLE
        if name in ("MIN", "MAX"):
            f = F.min if name == "MIN" else F.max
            if t.kind == "term":
                return (F.min_by if name == "MIN" else F.max_by)(c, order_key(c)), TERM
            if t.kind == "key":
                return f(to_lex(c, t)), IRI
            return f(c), t
        if name == "SAMPLE":
            return F.any_value(c, F.lit(True)), t
        lex = to_lex(c, t)
        values = F.sort_array(F.collect_set(lex) if distinct else F.collect_list(lex))
        return F.array_join(values, sep if sep is not None else ","), STRING

    @staticmethod
    def term_sum(c: Column, distinct: bool) -> Column:
        """A sum of terms is whole if all its numbers are."""
        add = F.sum_distinct if distinct else F.sum
        whole, broken = F.when(c["kind"] == "integer", c["lex"].try_cast("bigint")), convert(c, TERM, DOUBLE)
        literal_of = lambda kind, n: F.struct(F.lit(kind).alias("kind"), n.cast("string").alias("lex"), F.lit(None).cast("string").alias("lang"))
        return F.when(F.max(F.when(c["kind"] == "double", 1)).isNull(), literal_of("integer", F.coalesce(add(whole), F.lit(0)))).otherwise(literal_of("double", F.coalesce(add(broken), F.lit(0.0))))

    # -- patterns

    def unit(self) -> Sol:
        return Sol(self.spark.range(1).select(F.lit(1).alias(fresh("unit"))))

    def group(self, elements: list, scope: Scope) -> Sol:
        sol, filters = self.body(elements, scope)
        for e in filters:
            sol = self.filtered(e, sol, scope)
        return sol

    def body(self, elements: list, scope: Scope) -> tuple[Sol, list]:
        """The group's solutions before its filters, and the filters."""
        sol: Sol | None = None
        filters: list = []
        late = [e for e in elements if e[0] in ("optional", "minus")]
        services = [e for e in elements if e[0] == "service"]
        first_late = min((elements.index(e) for e in late), default=len(elements))
        order = [e for e in elements[:first_late] if e[0] != "service"] + services + [e for e in elements[first_late:] if e[0] != "service"]
        outer = self.hints
        for e in order:
            kind = e[0]
            if sol is not None:
                self.hints = outer | {v: {sol.type(v).prefix} for v in sol.bound if v in sol.vars and sol.type(v).kind == "key"}
            if kind == "filter":
                filters.append(e[1])
                continue
            if kind == "optional":
                inner, conditions = self.body(e[1], scope)
                left = sol or self.unit()
                inner = inner.renamed()
                simple = [x for x in conditions if not _has(x, "exists")]
                for x in conditions:
                    if x not in simple:
                        inner = self.filtered(x, inner, scope)
                cond = None
                if simple:
                    both = Sol(left.df, left.vars | {v: c for v, c in inner.vars.items() if v not in left.bound}, frozenset())
                    for x in simple:
                        c = truth(*self.expr(x, both, scope))
                        cond = c if cond is None else cond & c
                sol = join(left, inner, "left", cond)
                continue
            if kind == "minus":
                sol = minus(sol or self.unit(), self.group(e[1], scope).renamed())
                continue
            if kind == "bind":
                base = sol or self.unit()
                x, base = self.with_scalars(e[1], base, scope)
                sol = base.extend(e[2], *self.expr(x, base, scope))
                continue
            part = self.element(e, scope)
            sol = part if sol is None else join(sol, part)
        self.hints = outer
        return sol or self.unit(), filters

    def element(self, e, scope: Scope) -> Sol:
        kind = e[0]
        if kind == "triples":
            return self.bgp(e[1], scope)
        if kind == "group":
            return self.group(e[1], scope)
        if kind == "union":
            return reduce(union, (self.group(g, scope) for g in e[1]))
        if kind == "values":
            return self.values(e[1], e[2])
        if kind == "select":
            sol, names = self.select(e[1], scope)
            return sol.keep(names)
        if kind == "graph":
            return self.graph(e[1], e[2], scope)
        if kind == "service":
            return self.service(*e[1:])
        raise Unsupported(kind)

    def graph(self, term, elements: list, scope: Scope) -> Sol:
        if term[0] == "param":
            term = ("iri", str(self.param(term[1])))
        sol = self.group(elements, replace(scope, graph=term))
        if term[0] == "var" and term[1] not in sol.vars:
            g = self.data.named_graphs()
            cond = replace(scope, graph=term).condition(F.col("g"))
            column = fresh(term[1])
            names = (g.where(cond) if cond is not None else g).select(F.col("g").alias(column))
            sol = join(sol, Sol(names, {term[1]: (column, IRI)}, frozenset([term[1]])))
        return sol

    def service(self, silent: bool, term, elements: list, text: str) -> Sol:
        """Another dataset's solutions, or a remote endpoint's for the group as a query text."""
        try:
            if term[0] == "var":
                raise Unsupported("SERVICE with a variable")
            iri = str(self.param(term[1])) if term[0] == "param" else term[1]
            if self.allowed_services is not None and iri not in self.allowed_services:
                raise QueryFailed(f"service {iri} is not allowed")
            if iri not in self.services:
                raise QueryFailed(f"no service {iri}")
            held = self.services[iri]
            if isinstance(held, Dataset):
                return Compiler(held, self.params, self.services).group(elements, Scope()).renamed()
            df = held.terms(self.spark, text)
            out = {v: (fresh(v), TERM) for v in df.columns if v != "unit"}
            return Sol(df.toDF(*(out[v][0] if v in out else fresh("unit") for v in df.columns)), out, frozenset())
        except (QueryFailed, Unsupported):
            if silent:
                return self.unit()
            raise

    def values(self, names: list[str], rows: list[tuple]) -> Sol:
        cols, out, bound = [], {}, set()
        consts = [[self.constant(x) if x is not None else None for x in row] for row in rows]
        for k, v in enumerate(names):
            t = reduce(common, (r[k][1] for r in consts if r[k]), NULL)
            out[v] = (fresh(v), t)
            if all(r[k] for r in consts):
                bound.add(v)
        for r in consts:
            cols.append(F.struct(*((convert(*x, out[v][1]) if (x := r[k]) else null(out[v][1])).alias(out[v][0]) for k, v in enumerate(names))))
        one = self.spark.range(1)
        if not rows:
            return Sol(one.where(F.lit(False)).select(*(null(t).alias(c) for c, t in out.values())), out, frozenset())
        return Sol(one.select(F.inline(F.array(*cols))).toDF(*(c for c, _ in out.values())), out, frozenset(bound))

    # -- basic graph patterns

    def bgp(self, triples: list, scope: Scope) -> Sol:
        triples = [self.settled(t) for t in triples]
        matches: dict[tuple, list] = {}
        for t in triples:
            if t[1] == ("p", FTS + "match"):
                matches.setdefault(t[0], []).append(t[2])
        triples = [t for t in triples if t[1] != ("p", FTS + "match")]
        stars: dict[tuple, list] = {}
        parts: list[Sol] = []
        for s, p, o in triples:
            if p[0] == "p":
                stars.setdefault(s, []).append((p[1], o))
            elif p[0] == "var":
                parts.append(self.variable_predicate(s, p, o, scope))
            else:
                parts.append(self.path_triple(s, p, o, scope))
        outer = self.hints
        self.hints = outer | self.ranges(stars) if self.data.stored is None else {}
        parts = [self.star(s, po, scope) for s, po in stars.items()] + parts
        self.hints = outer
        for s, texts in matches.items():
            parts.append(self.match(s, texts, scope))
        if not parts:
            return self.unit()
        sol, rest = parts[0], parts[1:]
        subjects, several = {s[1] for s in stars if s[0] == "var"}, parts[: len(stars)]
        while rest:
            nxt = next((x for x in rest if set(x.vars) & set(sol.vars)), rest[0])
            rest.remove(nxt)
            shared = set(sol.vars) & set(nxt.vars)
            sol = (blocked if shared and not shared & subjects and any(nxt is x for x in several) else join)(sol, nxt)
        return sol

    def settled(self, t: tuple) -> tuple:
        """Parameters filled in, blank nodes as hidden variables, plain paths normalised."""

        def term(x):
            if x[0] == "param":
                v = self.param(x[1])
                return ("iri", str(v)) if str(v).startswith(("http", "urn:")) else ("lit", *_python_literal(v))
            return ("var", f".{x[1]}") if x[0] == "bnode" else x

        p = t[1]
        p = ("p", str(self.param(p[1]))) if p[0] == "param" else p
        return term(t[0]), p, term(t[2])

    def constant(self, term) -> tuple[Column, T]:
        if term[0] == "iri":
            return F.lit(term[1]), IRI
        if term[0] == "param":
            v = self.param(term[1])
            return (F.lit(v), IRI) if isinstance(v, str) and v.startswith(("http:", "https:", "urn:")) else literal(*_python_literal(v))
        if term[0] == "null":
            return null(), NULL
        return literal(*term[1:])

    def term(self, term, sol: Sol) -> tuple[Column, T]:
        if term[0] == "var":
            return (sol.col(term[1]), sol.type(term[1])) if term[1] in sol.vars else (null(), NULL)
        return self.constant(term)

    def tables_with(self, types: list[str], props: list[str]) -> list[tuple[ClassTable, dict[str, str]]]:
        """Tables of all the types that hold all the properties, with the column of each."""
        out = []
        for t in self.data.tables:
            up = self.onto.superclasses(t.cls)
            if not all(c in up for c in types):
                continue
            found = {}
            for p in props:
                have = [q for q in t.columns if q in self.onto.subproperties(p)]
                if len(have) != 1:
                    break
                found[p] = have[0]
            else:
                out.append((t, found))
        return out

    def ranges(self, stars: dict) -> dict[str, set[str]]:
        """Prefixes of the variables that only properties with resource ranges bind."""
        out: dict[str, set[str]] = {}
        for s, po in stars.items():
            types = [o[1] for p, o in po if p == RDF + "type" and o[0] == "iri"]
            props = [p for p, o in po if not (p == RDF + "type" and o[0] == "iri")]
            if not all(p in self.onto.properties for p in props) or RDF + "type" in props:
                continue
            if self.in_schema(s, types, props):
                continue
            found = self.tables_with(types, props)
            for p, o in po:
                if o[0] == "var" and found and p in props:
                    kinds = [t.columns[cols[p]][1] for t, cols in found]
                    if all(k.kind == "key" for k in kinds):
                        new = {k.prefix for k in kinds}
                        out[o[1]] = out[o[1]] & new if o[1] in out else new
        return out

    def star(self, s, po: list, scope: Scope) -> Sol:
        """All triples of one subject: a scan a table where tables hold them whole."""
        types = [o[1] for p, o in po if p == RDF + "type" and o[0] == "iri"]
        for c in types:
            self.onto.class_def(c)
        props = [(p, o) for p, o in po if not (p == RDF + "type" and o[0] == "iri")]
        for p, _ in props:
            self.onto.property_def(p)
        split = any(p == RDF + "type" for p, _ in props) or any(len([q for q in t.columns if q in self.onto.subproperties(p)]) > 1 for t in self.data.tables for p, _ in props)
        if not split:
            found = self.tables_with(types, list(dict.fromkeys(p for p, _ in props)))
            if s[0] == "var" and s[1] in self.hints:
                found = [(t, cols) for t, cols in found if t.key is None or t.prefix in self.hints[s[1]]]
            elif s[0] == "iri":
                found = [(t, cols) for t, cols in found if t.key is None or s[1].startswith(t.prefix)]
            self.star_uses = len(po)
            scans = [self.scan(t, cols, s, props, scope) for t, cols in found]
            scans = [x for x in scans if x is not None]
            if self.data.stored is not None:
                scans.append(reduce(join, (self.quad_triple(self.data.stored, s, p, o, scope) for p, o in po)))
            if self.in_schema(s, types, [p for p, _ in props]):
                own = reduce(join, (self.quad_triple(self.data.schema(), s, p, o, scope) for p, o in po))
                if not scans:  # as small as the ontology; what it meets may look small too, where a table's file unpivots into many times its size
                    own = replace(own, df=F.broadcast(own.df))
                scans.append(own)
            if scans:
                return reduce(union, scans)
            return self.empty([x[1] for x in (s, *(o for _, o in props)) if x[0] == "var"])
        parts = [self.property_triple(s, p, o, scope) for p, o in po]
        return reduce(join, parts)

    def in_schema(self, s, types: list[str], props: list[str]) -> bool:
        """Whether classes and properties themselves may be such a subject."""
        if s[0] == "var" and s[1] in self.hints or not all(c in SCHEMA_CLASSES for c in types):
            return False
        return all(p in SCHEMA_PROPERTIES or p == RDF + "type" for p in props) and (bool(props) or bool(types))

    def quad_pairs(self, quads: DataFrame, p: str, scope: Scope) -> tuple[DataFrame, T, T]:
        """(s, o, g) of one property among quads."""
        to = IRI if p == RDF + "type" else self.onto.property_def(p).type
        cond = scope.condition(F.col("g"))
        df = quads.where(F.col("p") == p)
        df = df.where(cond) if cond is not None else df
        df = df.select("s", convert(F.col("o"), TERM, to).alias("o"), "g")
        if scope.several and quads is self.data.stored:
            df = df.withColumn("_k", merged(F.col("o"), to)).dropDuplicates(["s", "_k"]).drop("_k")
        return df, IRI, to

    def quad_triple(self, quads: DataFrame, s, p: str, o, scope: Scope) -> Sol:
        df, ts, to = self.quad_pairs(quads, p, scope)
        return self.bound_pairs(df, ts, to, s, o, scope)

    def empty(self, names: list[str]) -> Sol:
        out = {v: (fresh(v), IRI) for v in dict.fromkeys(names)}
        df = self.spark.range(1).where(F.lit(False)).select(*(null(IRI).alias(c) for c, _ in out.values()) or [F.lit(1).alias("unit")])
        return Sol(df, out, frozenset(out))

    def bind_columns(self, df: DataFrame, slots: list[tuple[tuple, Column, T]]) -> Sol:
        """Terms against columns: constants filter, a repeated variable compares, others are named."""
        out: dict[str, tuple[str, T]] = {}
        first: dict[str, tuple[Column, T]] = {}
        cols = []
        for term, c, t in slots:
            if term[0] == "var":
                df = df.where(c.isNotNull())
                if term[1] in first:
                    df = df.where(equal(*first[term[1]], c, t))
                else:
                    first[term[1]] = (c, t)
                    out[term[1]] = (fresh(term[1]), t)
                    cols.append(c.alias(out[term[1]][0]))
            else:
                v, tv = self.constant(term)
                if t.kind == "key" and tv is IRI:
                    if not term[1].startswith(t.prefix):
                        df = df.where(F.lit(False))
                    else:
                        df = df.where(c == F.lit(term[1][len(t.prefix) :]).try_cast(t.raw))
                else:
                    df = df.where(equal(c, t, v, tv))
        return Sol(df.select(*cols) if cols else df.select(F.lit(1).alias(fresh("unit"))), out, frozenset(out))

    def scan(self, t: ClassTable, found: dict[str, str], s, props: list, scope: Scope) -> Sol | None:
        df = t.df
        cond = None
        if t.graph is None and scope.graph is None and scope.default is None and scope.allowed is None:
            pass
        else:
            cond = scope.condition(t.graph_column())
        if t.graph is None and scope.graph is not None and scope.named is None and (scope.graph[0] == "var" or scope.graph[1] != DEFAULT_GRAPH):
            return None
        if cond is not None:
            df = df.where(cond)
        slots = []
        if self.row is not None and s == ("var", self.row[0]) and t is self.row[1]:
            slots.append((s, F.struct(F.monotonically_increasing_id().alias("id"), F.struct(*t.df.columns).alias("row")), ROW))
        elif s[0] != "var" or t.key is not None or self.needs_subject(s):
            slots.append((s, *t.subject()))
        for p, o in props:
            e, kind = t.columns[found[p]]
            slots.append((o, F.expr(e), kind))
        if scope.graph is not None and scope.graph[0] == "var":
            slots.append((scope.graph, t.graph_column(), IRI))
        return self.bind_columns(df, slots)

    def needs_subject(self, s) -> bool:
        """Anonymous subjects are named only if the query uses them beside this scan."""
        return self.uses is None or self.uses.get(s[1], 0) > self.star_uses

    def property_pairs(self, p: str, scope: Scope, prefix: str | None = None) -> tuple[DataFrame, T, T]:
        """(s, o, g) of one property over tables and quads, with the types of s and o.

        With ``prefix`` tables of other subjects are left out.
        """
        if p != RDF + "type":
            self.onto.property_def(p)
        sub = self.onto.subproperties(p) if p in self.onto.properties else {p}
        parts: list[tuple[DataFrame, T, T]] = []
        for t in self.data.tables:
            if prefix is not None and t.key is not None and t.prefix != prefix:
                continue
            cond = scope.condition(t.graph_column())
            df = t.df if cond is None else t.df.where(cond)
            c, ts = t.subject()
            if p == RDF + "type":
                for cls in self.onto.superclasses(t.cls):
                    parts.append((df.select(c.alias("s"), F.lit(cls).alias("o"), t.graph_column().alias("g")), ts, IRI))
            for q in t.columns:
                if q in sub:
                    e, to = t.columns[q]
                    parts.append((df.select(c.alias("s"), F.expr(e).alias("o"), t.graph_column().alias("g")).where("o is not null"), ts, to))
        if self.data.stored is not None:
            parts.append(self.quad_pairs(self.data.stored, p, scope))
        if prefix is None and (p == RDF + "type" or p in SCHEMA_PROPERTIES):
            parts.append(self.quad_pairs(self.data.schema(), p, scope))
        if not parts:
            return self.spark.createDataFrame([], "s string, o string, g string"), IRI, IRI
        ts, to = reduce(common, (x[1] for x in parts)), reduce(common, (x[2] for x in parts))
        dfs = [df.select(convert(F.col("s"), a, ts).alias("s"), convert(F.col("o"), b, to).alias("o"), "g") for df, a, b in parts]
        return reduce(DataFrame.union, dfs), ts, to

    def property_triple(self, s, p: str, o, scope: Scope) -> Sol:
        return self.bound_pairs(*self.property_pairs(p, scope), s, o, scope)

    def bound_pairs(self, df: DataFrame, ts: T, to: T, s, o, scope: Scope) -> Sol:
        slots = [(s, F.col("s"), ts), (o, F.col("o"), to)]
        if scope.graph is not None and scope.graph[0] == "var":
            slots.append((scope.graph, F.col("g"), IRI))
        return self.bind_columns(df, slots)

    def quads(self, scope: Scope) -> DataFrame:
        """Every quad in view, the schema's too."""
        df = self.data.quads().unionByName(self.data.schema())
        cond = scope.condition(F.col("g"))
        return df if cond is None else df.where(cond)

    def variable_predicate(self, s, p, o, scope: Scope) -> Sol:
        df = self.quads(scope)
        if scope.several and self.data.stored is not None:
            df = df.dropDuplicates(["s", "p", "o"])
        slots = [(s, F.col("s"), IRI), (p, F.col("p"), IRI), (o, F.col("o"), TERM)]
        if scope.graph is not None and scope.graph[0] == "var":
            slots.append((scope.graph, F.col("g"), IRI))
        return self.bind_columns(df, slots)

    def path_triple(self, s, p, o, scope: Scope) -> Sol:
        df, ts, to = paths.pairs(self, p, scope, s if s[0] != "var" else None, o if o[0] != "var" else None)
        return self.bind_columns(df, [(s, F.col("s"), ts), (o, F.col("o"), to)])

    def match(self, s, texts: list, scope: Scope) -> Sol:
        texts = [self.text_of(t) for t in texts]
        calls = []
        if s[0] == "var":
            self.matches[s[1]] = texts
            calls = self.calls.get(s[1], [])
        found, types = fts.search(self, texts, scope, calls)
        made = [(("var", _fts_name(s[1], *call)), F.col(f"v{k}"), types[k]) for k, call in enumerate(calls)]
        return self.bind_columns(found, [(s, F.col("s"), IRI), *made])

    def text_of(self, term) -> str:
        if term[0] == "param":
            return str(self.param(term[1]))
        if term[0] != "lit":
            raise ParseError("a match takes a constant text")
        return term[1]

    # -- expressions

    def filtered(self, e, sol: Sol, scope: Scope) -> Sol:
        if e[0] == "and":
            return self.filtered(e[2], self.filtered(e[1], sol, scope), scope)
        if e[0] == "not" and e[1][0] == "exists":
            e = ("exists", e[1][1], not e[1][2])
        if e[0] == "exists":
            return self.exists(e[1], e[2], sol, scope)
        e, sol = self.with_scalars(e, sol, scope)
        return sol.where(truth(*self.expr(e, sol, scope)))

    def exists(self, elements: list, negated: bool, sol: Sol, scope: Scope) -> Sol:
        """A semi or anti join; filters on outer variables join the condition."""
        inner, cond = self.tested(elements, sol, scope)
        return semi(sol, inner, negated, cond)

    def tested(self, elements: list, sol: Sol, scope: Scope) -> tuple[Sol, Column | None]:
        """The solutions that an EXISTS looks for, and its filters on outer variables."""
        inner, filters = self.body(elements, scope)
        late = [f for f in filters if not _vars(f) <= set(inner.vars) and not _has(f, "exists")]
        for f in filters:
            if f not in late:
                inner = self.filtered(f, inner, scope)
        inner = inner.renamed()
        both = _Both(sol, inner)
        cond = None
        for f in late:
            c = truth(*self.expr(f, both, scope))
            cond = c if cond is None else cond & c
        return inner, cond

    def with_scalars(self, e, sol: Sol, scope: Scope):
        """Replaces EXISTS, scalar sub-queries and property functions by columns joined in."""
        state = [sol]

        def walk(x):
            if not isinstance(x, tuple):
                return [walk(y) for y in x] if isinstance(x, list) else x
            if x and x[0] == "exists":
                sol = state[0]
                inner, cond = self.tested(x[1], replace(sol, outer=True), scope)
                flag = fresh("flag")
                name = f".exists{flag}"
                state[0] = Sol(flagged(sol, inner, flag, cond), sol.vars | {name: (flag, BOOLEAN)}, sol.bound)
                test = ("term", ("var", name))
                return ("not", test) if x[2] else test
            if x and x[0] == "scalar":
                sub, names = self.select(x[1], scope)
                c = fresh("scalar")
                one = sub.df.limit(1).select(sub.col(names[0]).alias(c))
                name = f".scalar{c}"
                state[0] = join(state[0], Sol(one, {name: (c, sub.type(names[0]))}), "left")
                return ("term", ("var", name))
            if x and x[0] == "call" and x[1] in self.onto.properties and len(x[2]) == 1:
                return self.property_call(x, state, scope)
            if x and x[0] == "call" and x[1] == GL + "uri" and len(x[2]) == 1:
                return self.uri_call(x, state, scope)
            if x and x[0] == "call" and x[1].startswith(FTS):
                return self.fts_call(x, state, scope)
            return tuple(walk(y) for y in x)

        return walk(e), state[0]

    def property_call(self, x, state: list[Sol], scope: Scope):
        """A property as a function: its value, or all of them joined by commas."""
        arg = x[2][0]
        if arg[0] == "call" and arg[1] in self.onto.properties:
            arg = self.property_call(arg, state, scope)
        if arg[0] != "term" or arg[1][0] != "var":
            raise ParseError("a property function takes a variable")
        d = self.onto.property_def(x[1])
        df, ts, to = self.property_pairs(x[1], replace(scope, graph=None))
        s, v = fresh("s"), fresh("v")
        if d.single:
            df = df.groupBy(F.col("s").alias(s)).agg(F.any_value("o", F.lit(True)).alias(v))
        else:
            df, to = df.groupBy(F.col("s").alias(s)).agg(F.array_join(F.sort_array(F.collect_set(to_lex(F.col("o"), to))), ",").alias(v)), STRING
        name = f".property{v}"
        state[0] = join(state[0], Sol(df, {arg[1][1]: (s, ts), name: (v, to)}, frozenset([arg[1][1]])), "left")
        return ("term", ("var", name))

    def uri_call(self, x, state: list[Sol], scope: Scope):
        """The IRI of an id: a join with the ids of the graph's resources."""
        c, t = self.expr(x[2][0], state[0], scope)
        wanted, found, name = fresh("id"), fresh("id"), fresh("uri")
        q = self.quads(replace(scope, graph=None))
        nodes = q.select(F.col("s").alias("n")).union(q.where(F.col("o.kind").isin("iri", "bnode")).select("o.lex")).distinct()
        ids, _ = builtins.build(GL + "id", [(F.col("n"), IRI)])
        df = state[0].df.withColumn(wanted, convert(c, t, INTEGER)).join(nodes.select(ids.alias(found), F.col("n").alias(name)), F.col(wanted) == F.col(found), "left")
        state[0] = Sol(df, state[0].vars | {f".{name}": (name, IRI)}, state[0].bound)
        return ("term", ("var", f".{name}"))

    def fts_call(self, x, state: list[Sol], scope: Scope):
        """A full-text function's value: made beside its match, or joined in where that is out of reach."""
        var, name, constants = _fts_call(x)
        hidden = _fts_name(var, name, constants)
        if hidden not in state[0].vars:
            if var not in self.matches:
                raise ParseError(f"{name} needs a match of ?{var} in the same query")
            df, types = fts.search(self, self.matches[var], scope, [(name, constants)])
            s, v = fresh("s"), fresh("v")
            df = df.select(F.col("s").alias(s), F.col("v0").alias(v))
            state[0] = join(state[0], Sol(df, {var: (s, IRI), hidden: (v, types[0])}, frozenset([var])), "left")
        return ("term", ("var", hidden))

    def expr(self, e, sol: Sol, scope: Scope) -> tuple[Column, T]:
        kind = e[0]
        if kind == "term":
            return self.term(e[1], sol)
        if kind in ("and", "or"):
            a, b = (truth(*self.expr(x, sol, scope)) for x in e[1:])
            return (a & b if kind == "and" else a | b), BOOLEAN
        if kind == "not":
            return ~truth(*self.expr(e[1], sol, scope)), BOOLEAN
        if kind == "cmp":
            a, b = self.expr(e[2], sol, scope), self.expr(e[3], sol, scope)
            if e[1] in ("=", "!="):
                c = self.same(a, b)
                return (c if e[1] == "=" else ~c), BOOLEAN
            return less(e[1], *a, *b), BOOLEAN
        if kind == "in":
            a = self.expr(e[1], sol, scope)
            tests = [self.same(a, self.expr(x, sol, scope)) for x in e[2]]
            c = reduce(lambda x, y: x | y, tests) if tests else F.lit(False)
            return (~c if e[3] else c), BOOLEAN
        if kind == "arith":
            return self.arithmetic(e[1], self.expr(e[2], sol, scope), self.expr(e[3], sol, scope))
        if kind == "minus":
            c, t = self.expr(e[1], sol, scope)
            return -builtins.number((c, t)), t if t.numeric else DOUBLE
        if kind == "call":
            return self.call(e[1], e[2], sol, scope)
        if kind == "agg":
            raise ParseError(f"{e[1]} outside SELECT, HAVING and ORDER BY")
        raise Unsupported(f"{kind} in an expression")

    @staticmethod
    def same(a, b) -> Column:
        """Equality; a key column against an IRI constant compares raw keys."""
        for (c, t), (d, u) in ((a, b), (b, a)):
            if t.kind == "key" and u is IRI and (text := builtins.constant(d)) is not None:
                return c == F.lit(text[len(t.prefix) :]).try_cast(t.raw) if text.startswith(t.prefix) else c.isNull() & c.isNotNull()
        return equal(*a, *b)

    @staticmethod
    def arithmetic(op: str, a, b) -> tuple[Column, T]:
        x, y = builtins.number(a), builtins.number(b)
        whole = a[1] is INTEGER and b[1] is INTEGER
        if op == "/":
            return F.try_divide(x.cast("double"), y.cast("double")), DOUBLE
        if not whole:
            x, y = x.cast("double"), y.cast("double")
        f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op] if whole else {"+": lambda p, q: p + q, "-": lambda p, q: p - q, "*": lambda p, q: p * q}[op]
        return f(x, y), INTEGER if whole else DOUBLE

    def call(self, name: str, args: list, sol: Sol, scope: Scope) -> tuple[Column, T]:
        if name == FN + "string-join":
            items = args[0][1] if args[0][0] == "list" else [args[0]]
            return builtins.string_join([self.expr(x, sol, scope) for x in items], self.expr(args[1], sol, scope))
        return builtins.build(name, [self.expr(x, sol, scope) for x in args])


class _Both:
    """Variables of two sequences as an expression sees them; the first one's go first."""

    def __init__(self, first: Sol, second: Sol):
        self.first, self.second = first, second
        self.vars = second.vars | first.vars

    def col(self, v: str) -> Column:
        return (self.first if v in self.first.vars else self.second).col(v)

    def type(self, v: str) -> T:
        return self.vars[v][1]


def _python_literal(v) -> tuple[str, str | None, str | None]:
    if isinstance(v, tuple):
        return v[0], None, v[1]
    if isinstance(v, bool):
        return str(v).lower(), XSD + "boolean", None
    if isinstance(v, int):
        return str(v), XSD + "integer", None
    if isinstance(v, float):
        return repr(v), XSD + "double", None
    if hasattr(v, "isoformat"):
        return v.isoformat(), XSD + ("dateTime" if hasattr(v, "hour") else "date"), None
    return str(v), None, None


def _uses(q: Query) -> dict[str, int]:
    """How often each variable stands in a query."""
    out: dict[str, int] = {}

    def walk(x) -> None:
        if isinstance(x, Query):
            for y in vars(x).values():
                walk(y)
        elif isinstance(x, tuple) and len(x) == 2 and x[0] == "var" and isinstance(x[1], str):
            out[x[1]] = out.get(x[1], 0) + 1
        elif isinstance(x, (tuple, list)):
            for y in x:
                walk(y)

    walk(q)
    return out


def _fts_call(x) -> tuple[str, str, list]:
    """Variable, name and constant arguments of a full-text function."""
    return x[2][0][1][1], x[1][len(FTS) :], [a[1][1] if a[0] == "term" and a[1][0] == "lit" else None for a in x[2][1:]]


def _fts_name(var: str, name: str, constants: list) -> str:
    return f".fts {var} {name} {constants}"


def _fts_calls(q: Query) -> dict[str, list]:
    """The full-text functions that a query calls, by variable."""
    out: dict[str, list] = {}

    def walk(x) -> None:
        if isinstance(x, Query):
            for y in vars(x).values():
                walk(y)
        elif isinstance(x, tuple) and len(x) == 3 and x[0] == "call" and isinstance(x[1], str) and x[1].startswith(FTS):
            var, name, constants = _fts_call(x)
            if (name, constants) not in out.setdefault(var, []):
                out[var].append((name, constants))
        elif isinstance(x, (tuple, list)):
            for y in x:
                walk(y)

    walk(q)
    return out


def _has(e, kind: str) -> bool:
    return isinstance(e, tuple) and bool(e) and (e[0] == kind or any(_has(x, kind) for x in e)) or isinstance(e, list) and any(_has(x, kind) for x in e)


def _has_agg(e) -> bool:
    return _has(e, "agg")


def _frozen(e) -> str:
    return repr(e)


def _vars(e) -> set[str]:
    if isinstance(e, tuple):
        if len(e) == 2 and e[0] == "var" and isinstance(e[1], str):
            return {e[1]}
        return set().union(*(_vars(x) for x in e)) if e else set()
    if isinstance(e, list):
        return set().union(*(_vars(x) for x in e)) if e else set()
    return set()


__all__ = ["Compiler", "Scope", "to_term"]
