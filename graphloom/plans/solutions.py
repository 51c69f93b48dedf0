"""Solution sequences: a DataFrame, a typed column for each variable, and which are surely bound."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..terms import T, common, comparable, convert, equal, merged, null

_ids = itertools.count()


def fresh(name: str) -> str:
    """A column name that no other column of any plan has."""
    return f"{re.sub(r'[^A-Za-z0-9_]', '_', name)}__{next(_ids)}"


@dataclass
class Sol:
    df: DataFrame
    vars: dict[str, tuple[str, T]] = field(default_factory=dict)
    bound: frozenset[str] = frozenset()
    #: Whether columns are those of the query around a correlated sub-query.
    outer: bool = False

    def col(self, v: str) -> Column:
        c = F.col(self.vars[v][0])
        return c.outer() if self.outer else c

    def type(self, v: str) -> T:
        return self.vars[v][1]

    def where(self, cond: Column) -> Sol:
        return Sol(self.df.where(cond), self.vars, self.bound)

    def extend(self, name: str, c: Column, t: T, bound: bool = False) -> Sol:
        column = fresh(name)
        return Sol(self.df.withColumn(column, c), self.vars | {name: (column, t)}, self.bound | ({name} if bound else set()))

    def renamed(self) -> Sol:
        """The same rows under fresh column names, so that it can meet itself in a join."""
        names = {v: fresh(v) for v in self.vars}
        df = self.df.select(*(F.col(c).alias(names[v]) for v, (c, _) in self.vars.items())) if self.vars else self.df.select(F.lit(1).alias(fresh("unit")))
        return Sol(df, {v: (names[v], t) for v, (_, t) in self.vars.items()}, self.bound)

    def keep(self, names: list[str]) -> Sol:
        have = [v for v in names if v in self.vars]
        df = self.df.select(*(F.col(self.vars[v][0]) for v in have)) if have else self.df.select(F.lit(1).alias(fresh("unit")))
        return Sol(df, {v: self.vars[v] for v in have}, self.bound & set(have))


def _typed(l: Sol, r: Sol, shared: list[str]) -> dict[str, T]:
    """Types in which shared variables compare; those that a side never binds are left out."""
    return {v: comparable(l.type(v), r.type(v)) for v in shared if "null" not in (l.type(v).kind, r.type(v).kind)}


def _match(l: Sol, r: Sol, shared: list[str]) -> Column:
    """Equality, or compatibility where one side may be unbound, of shared variables."""
    cond = F.lit(True)
    for v, t in _typed(l, r, shared).items():
        ca, cb = l.col(v), r.col(v)
        same = merged(convert(ca, l.type(v), t), t) == merged(convert(cb, r.type(v), t), t)
        if not (v in l.bound and v in r.bound):
            same = ca.isNull() | cb.isNull() | same
        cond = cond & same
    return cond


def _mask(s: Sol, loose: list[str]) -> Column:
    """Which of the variables a row binds, as bits."""
    return sum((F.when(s.col(v).isNotNull(), 1 << k).otherwise(0) for k, v in enumerate(loose)), F.lit(0))


def _meeting(l: Sol, r: Sol, shared: list[str]) -> tuple[DataFrame, DataFrame, Column | None]:
    """Both sides and an equi join condition for compatible rows.

    Where variables may be unbound, a row is keyed once for each set of
    variables that rows of the other side may bind: by that set, its own set
    and the values that both bind. Only ``r`` is repeated if ``l`` alone has
    such variables, so any kind of join may then use the condition.
    """
    types = _typed(l, r, shared)
    loose_l, loose_r = ([v for v in types if v not in s.bound] for s in (l, r))
    if not loose_l and not loose_r:
        return l.df, r.df, _match(l, r, shared) if types else None

    def keyed(s: Sol, own: list[str], other: list[str], left: bool) -> tuple[DataFrame, list[str]]:
        mine, theirs = fresh("bits"), fresh("bits")
        every = F.explode(F.sequence(F.lit(0), F.lit((1 << len(other)) - 1))) if other else F.lit(0)
        df = s.df.withColumn(mine, _mask(s, own)).withColumn(theirs, every)
        names = [mine, theirs] if left else [theirs, mine]
        for v, t in types.items():
            value = merged(convert(s.col(v), s.type(v), t), t)
            if v in other:
                value = F.when(F.col(theirs).bitwiseAND(1 << other.index(v)) != 0, value)
            names.append(fresh(v))
            df = df.withColumn(names[-1], value)
        return df, names

    ldf, a = keyed(l, loose_l, loose_r, True)
    rdf, b = keyed(r, loose_r, loose_l, False)
    cond = F.lit(True)
    for x, y in zip(a, b):
        cond = cond & F.col(x).eqNullSafe(F.col(y))
    return ldf, rdf, cond


def _bindings(l: Sol, r: Sol) -> list[Sol]:
    """``r`` cut by the shared variables that its rows bind, so that each part surely binds its own."""
    loose = [v for v in r.vars if v in l.vars and v not in r.bound and "null" not in (l.type(v).kind, r.type(v).kind)]
    if not loose:
        return [r]
    out = []
    for bits in range(1 << len(loose)):
        have = {v for k, v in enumerate(loose) if bits >> k & 1}
        part = r.where(_mask(r, loose) == bits)
        out.append(Sol(part.df, {v: c for v, c in r.vars.items() if v in have or v not in loose}, r.bound | have))
    return out


def join(l: Sol, r: Sol, how: str = "inner", condition: Column | None = None) -> Sol:
    """Join on all shared variables; for a left join, also on ``condition``."""
    if how == "left" and len(parts := _bindings(l, r)) > 1:
        alone = l
        for part in parts:
            alone = semi(alone, part, True, condition)
        # The rows that meet none keep their left values; names are made apart before both are united.
        return union(join(l, r, "matched", condition), alone.renamed())
    shared = [v for v in l.vars if v in r.vars]
    ldf, rdf, cond = _meeting(l, r, shared)
    if condition is not None:
        cond = condition if cond is None else cond & condition
    kind = "inner" if how == "matched" else how
    df = ldf.crossJoin(rdf) if cond is None and kind == "inner" else ldf.join(rdf, cond if cond is not None else F.lit(True), kind)
    out, bound = dict(l.vars), l.bound
    for v in r.vars:
        if v not in l.vars:
            out[v] = r.vars[v]
    for v in shared:
        if v not in l.bound:
            t = common(l.type(v), r.type(v))
            column = fresh(v)
            df = df.withColumn(column, F.coalesce(convert(l.col(v), l.type(v), t), convert(r.col(v), r.type(v), t)))
            out[v] = (column, t)
    if kind == "inner":
        bound = bound | r.bound
    return Sol(df, out, bound).keep(list(out)) if shared else Sol(df, out, bound)


#: Rows of one key that a task joins with all rows of the other side.
BLOCK = 1024


def blocked(l: Sol, r: Sol) -> Sol:
    """A join of surely bound variables of which none names a row: many rows meet many.

    The work is a product by key, so a key's rows of ``l`` are cut into blocks,
    each of which meets the key's rows of ``r`` in a place of its own.
    """
    shared = [v for v in l.vars if v in r.vars]
    types = _typed(l, r, shared)
    if len(types) < len(shared) or not all(v in l.bound and v in r.bound for v in shared):
        return join(l, r)
    a, b, c = ([fresh(v) for v in shared] for _ in range(3))
    keyed = lambda s, names: s.df.withColumns({k: merged(convert(s.col(v), s.type(v), types[v]), types[v]) for v, k in zip(shared, names)})
    ldf, rdf, (n, x, y) = keyed(l, a), keyed(r, b), (fresh(z) for z in ("blocks", "block", "block"))
    sizes = ldf.groupBy(*(F.col(k).alias(z) for k, z in zip(a, c))).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(n))
    meets = lambda names, others: reduce(lambda p, q: p & q, (F.col(k) == F.col(z) for k, z in zip(names, others)))
    parts = int(l.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ldf = ldf.join(sizes, meets(a, c)).withColumn(x, F.pmod(F.xxhash64(*(F.col(k) for k, _ in l.vars.values())), F.col(n)).cast("int")).drop(*c, n).repartition(parts, *a, x)
    rdf = rdf.join(sizes, meets(b, c)).withColumn(y, F.explode(F.sequence(F.lit(0), F.col(n) - 1))).drop(*c, n).repartition(parts, *b, y)
    df = ldf.join(rdf, meets([*a, x], [*b, y]))
    out = l.vars | {v: z for v, z in r.vars.items() if v not in l.vars}
    return Sol(df, out, l.bound | r.bound).keep(list(out))


def semi(l: Sol, r: Sol, negated: bool, condition: Column | None = None, own: bool = False) -> Sol:
    """Rows of ``l`` with (or without) a compatible row of ``r``; ``own``: the condition is on ``l`` alone."""
    parts = _bindings(l, r)
    if len(parts) > 1:
        if negated:
            for part in parts:
                l = semi(l, part, True, condition, own)
            return l
        rest, found = l, []
        for part in parts:
            found.append(semi(rest, part, False, condition, own).df.select(*l.df.columns))
            rest = semi(rest, part, True, condition, own)
        return Sol(reduce(DataFrame.union, found), l.vars, l.bound)
    shared = [v for v in l.vars if v in r.vars]
    if condition is None or own:
        # A second equal row of ``r`` decides nothing; many rows of few values would all meet in a few tasks.
        shared = list(_typed(l, r, shared))
        r = r.keep(shared)
        r = Sol(r.df.distinct(), r.vars, r.bound)
    ldf, rdf, cond = _meeting(l, r, shared)
    if condition is not None:
        cond = condition if cond is None else cond & condition
    return Sol(ldf.join(rdf, cond if cond is not None else F.lit(True), "left_anti" if negated else "left_semi").select(*l.df.columns), l.vars, l.bound)


def flagged(l: Sol, r: Sol, flag: str, condition: Column | None = None) -> DataFrame:
    """``l`` with a column that tells whether a compatible row of ``r`` exists."""
    out = Sol(l.df, l.vars, l.bound, outer=True)
    cond = _match(out, r, [v for v in l.vars if v in r.vars])
    return l.df.withColumn(flag, r.df.where(cond if condition is None else cond & condition).exists())


def minus(l: Sol, r: Sol) -> Sol:
    """Rows of ``l`` without a compatible row of ``r`` that shares a bound variable."""
    for part in _bindings(l, r):
        shared = [v for v in _typed(l, part, [v for v in l.vars if v in part.vars])]
        if not shared:
            continue
        some = None
        if not any(v in l.bound for v in shared):
            some = reduce(lambda a, b: a | b, (l.col(v).isNotNull() for v in shared))
        l = semi(l, part, True, some, own=True)
    return l


def union(l: Sol, r: Sol) -> Sol:
    """Both sequences; a variable that one side lacks is unbound there."""
    names = [*l.vars, *(v for v in r.vars if v not in l.vars)]
    out, a, b = {}, [], []
    for v in names:
        tl, tr = (s.type(v) if v in s.vars else None for s in (l, r))
        t = common(tl, tr) if tl and tr else tl or tr
        column = fresh(v)
        out[v] = (column, t)
        a.append((convert(l.col(v), tl, t) if tl else null(t)).alias(column))
        b.append((convert(r.col(v), tr, t) if tr else null(t)).alias(column))
    if not names:
        a = b = [F.lit(1).alias(fresh("unit"))]
    casts = [x for x in zip(a, b)]
    left, right = l.df.select(*(x for x, _ in casts)), r.df.select(*(y for _, y in casts))
    return Sol(left.union(right), out, l.bound & r.bound)


__all__ = ["Sol", "fresh", "blocked", "join", "semi", "minus", "union", "equal", "flagged"]
