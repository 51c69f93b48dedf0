"""Property paths as pair tables (s, o).

Sequences are joins, alternatives bag unions, negated sets one filter over the
quad view. Closures are a semi-naive loop: only new pairs meet the edges, and
each round's pairs are written to the shared scratch folder, so cycles end and
no plan grows. A bound end seeds the loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise
from ..terms import IRI, TERM, T, common, comparable, convert, merged, to_term



def pairs(c, path, scope, start=None, end=None, prefix=None) -> tuple[DataFrame, T, T]:
    """Pairs of a path; ``start``, ``end`` (constant terms) and the subjects' ``prefix`` only prune."""
    kind = path[0]
    if kind == "p":
        df, ts, to = c.property_pairs(path[1], scope, prefix)
        return df.select("s", "o"), ts, to
    if kind == "inv":
        df, ts, to = pairs(c, path[1], scope, end, start)
        return df.select(F.col("o").alias("s"), F.col("s").alias("o")), to, ts
    if kind == "seq":
        left = pairs(c, path[1], scope, start, None, prefix)
        known = left[2].prefix if left[2].kind == "key" and c.data.stored is None else None
        return _sequence(left, pairs(c, path[2], scope, None, end, known))
    if kind == "alt":
        return _union([pairs(c, path[1], scope, start, end), pairs(c, path[2], scope, start, end)])
    if kind == "neg":
        return _negated(c, path[1], scope)
    inner = pairs(c, path[1], scope)
    if kind == "opt":
        df, ts, to = _union([inner, _zero(c, scope, start, end)])
        return _distinct(df, ts, to), ts, to
    closed = _closure(c, inner, start, end)
    if kind == "plus":
        return closed
    df, ts, to = _union([closed, _zero(c, scope, start, end)])
    return _distinct(df, ts, to), ts, to


def _distinct(df: DataFrame, ts: T, to: T) -> DataFrame:
    if ts.kind == "term" or to.kind == "term":
        return df.withColumn("_s", merged(F.col("s"), ts)).withColumn("_o", merged(F.col("o"), to)).dropDuplicates(["_s", "_o"]).select("s", "o")
    return df.select("s", "o").distinct()


def _sequence(a, b) -> tuple[DataFrame, T, T]:
    (l, ls, lo), (r, rs, ro) = a, b
    t = comparable(lo, rs)
    left = l.select("s", merged(convert(F.col("o"), lo, t), t).alias("_m"))
    right = r.select(merged(convert(F.col("s"), rs, t), t).alias("_m"), "o")
    return left.join(right, "_m").select("s", "o"), ls, ro


def _union(parts: list) -> tuple[DataFrame, T, T]:
    ts, to = reduce(common, (p[1] for p in parts)), reduce(common, (p[2] for p in parts))
    dfs = [df.select(convert(F.col("s"), a, ts).alias("s"), convert(F.col("o"), b, to).alias("o")) for df, a, b in parts]
    return reduce(DataFrame.union, dfs), ts, to


def _negated(c, props, scope) -> tuple[DataFrame, T, T]:
    """Quads with none of the forward properties, and with none of the inverse ones turned round."""
    quads, out = c.quads(scope), []
    forward, inverse = [p for p, i in props if not i], [p for p, i in props if i]
    if forward or not inverse:
        out.append((quads.where(~F.col("p").isin(*forward)).select("s", "o"), IRI, TERM))
    if inverse:
        out.append((quads.where(~F.col("p").isin(*inverse)).select(F.col("o").alias("s"), to_term(F.col("s"), IRI).alias("o")), TERM, TERM))
    return _union(out)


def _zero(c, scope, start, end) -> tuple[DataFrame, T, T]:
    """Zero-length pairs: of a bound end, or of every term of the graph."""
    given = start or end
    if given is not None:
        v, t = c.constant(given)
        return c.spark.range(1).select(v.alias("s"), v.alias("o")), t, t
    quads = c.quads(scope)
    # Classes are nodes as objects of rdf:type like any other object.
    nodes = quads.select(to_term(F.col("s"), IRI).alias("n")).union(quads.select(F.col("o").alias("n"))).distinct()
    return nodes.select(F.col("n").alias("s"), F.col("n").alias("o")), TERM, TERM


def _closure(c, inner, start, end) -> tuple[DataFrame, T, T]:
    edges, ts, to = inner
    t = common(ts, to)
    if t.kind == "term" and "term" not in (ts.kind, to.kind):
        # Nothing that is an object can be a subject: one step is all there is.
        return _distinct(edges, ts, to), ts, to
    as_one = edges.select(convert(F.col("s"), ts, t).alias("s"), convert(F.col("o"), to, t).alias("o"))
    edges = materialise(_distinct(as_one, t, t), "edges")
    step = edges.select(F.col("s").alias("_m"), F.col("o").alias("_n"))
    backwards = start is None and end is not None
    delta = edges
    if start is not None:
        delta = c.bind_columns(edges, [(start, F.col("s"), t), (("var", "o"), F.col("o"), t)])
        v, tv = c.constant(start)
        delta = delta.df.select(_constant(v, tv, t, start).alias("s"), delta.col("o").alias("o"))
    elif backwards:
        found = c.bind_columns(edges, [(("var", "s"), F.col("s"), t), (end, F.col("o"), t)])
        v, tv = c.constant(end)
        delta = found.df.select(found.col("s").alias("s"), _constant(v, tv, t, end).alias("o"))
    total = delta = materialise(delta.distinct(), "delta")
    rounds = 0
    while not delta.isEmpty():
        if backwards:
            new = delta.join(step, F.col("s").eqNullSafe(F.col("_n"))).select(F.col("_m").alias("s"), "o")
        else:
            new = delta.join(step, F.col("o").eqNullSafe(F.col("_m"))).select("s", F.col("_n").alias("o"))
        delta = materialise(new.distinct().join(total, ["s", "o"], "left_anti").select("s", "o"), "delta")
        total = total.union(delta)
        rounds += 1
        if rounds % 8 == 0:  # long chains: one table instead of one for each round
            total = materialise(total, "closure")
    return total, t, t


def _constant(v, tv: T, t: T, term):
    if t.kind == "key":
        return F.lit(term[1][len(t.prefix) :]).try_cast(t.raw)
    return convert(v, tv, t)


__all__ = ["pairs"]
