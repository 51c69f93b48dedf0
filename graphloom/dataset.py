"""Graph data: class tables mapped from DataFrames, and quads.

A class table is one scan: a row is a subject, a column a single-valued
property. Quads hold what was loaded or inserted: ``g``, ``s``, ``p`` strings
and ``o`` a term struct. A dataset is an immutable snapshot.

A subject's quads lie whole in one place. An update takes the subjects that it
touches out of the tables and the stored quads (an anti join on their names)
and keeps their new quads as a delta, so what it writes grows with the change.
Deltas are merged with each other now and then, never with what they change.
Where an update only gives rows of class tables other values, the changed rows
are a class table too, beside the one that they leave.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ontology import Ontology
from .runtime import materialise_at, spread, table_path
from .terms import IRI, TERM_SQL, T, to_lex, to_term
from .vocab import DEFAULT_GRAPH, RDF

QUAD_SQL = f"g string, s string, p string, o {TERM_SQL}"


@dataclass(frozen=True)
class ClassTable:
    """``key`` None: subjects are anonymous, named from all columns only where needed.

    ``columns`` maps a property to (SQL expression, type); ``graph`` is an SQL
    expression of the graph's IRI, None for the default graph. A subject's
    rows lie in one graph, and tables have distinct prefixes.
    """

    cls: str
    df: DataFrame
    prefix: str
    key: str | None
    columns: dict[str, tuple[str, T]]
    graph: str | None = None
    #: Column that stores the names of anonymous subjects whose rows have changed since.
    named: str | None = None

    def subject(self) -> tuple[Column, T]:
        if self.named is not None:
            return F.coalesce(F.col(self.named), F.lit("urn:bnode:")), IRI
        if self.key is None:
            return anonymous_name(self.df.columns), IRI
        return F.expr(self.key), T("key", self.prefix, self.df.select(F.expr(self.key)).dtypes[0][1])

    @property
    def start(self) -> str:
        """How all its subjects' names begin."""
        return "urn:bnode:" if self.key is None else self.prefix

    def holds(self, subjects: DataFrame, how: str) -> ClassTable:
        """The table with (``left_semi``) or without (``left_anti``) some subjects ``s``."""
        if self.key is None:
            # Names are made once and meet as digests of half their size.
            wanted = subjects.where(F.rlike("s", F.lit("^urn:bnode:[0-9a-f]{64}$"))).select(digest(F.col("s")).alias("_subject"))
            return replace(self, df=self.df.withColumn("_digest", digest(self.subject()[0])).join(wanted, F.col("_digest") == F.col("_subject"), how).drop("_digest"))
        c, t = self.subject()
        raw = F.substring(F.col("s"), len(self.prefix) + 1, 1 << 30)
        keys = subjects.where(F.startswith("s", F.lit(self.prefix)) & (raw.try_cast(t.raw).cast("string") == raw)).select(raw.try_cast(t.raw).alias("_subject"))
        return replace(self, df=self.df.join(keys, c == F.col("_subject"), how))

    def without(self, subjects: DataFrame, among: Column | None) -> ClassTable:
        """The table without some subjects; rows outside ``among`` hold none of them and meet nothing."""
        if among is None:
            return self.holds(subjects, "left_anti")
        inside = F.coalesce(among, F.lit(False))
        return replace(self, df=self.df.where(~inside).union(replace(self, df=self.df.where(inside)).holds(subjects, "left_anti").df))

    def graph_column(self) -> Column:
        return F.lit(DEFAULT_GRAPH) if self.graph is None else F.expr(self.graph)

    def quads(self, ontology: Ontology, only: set[str] | None = None) -> DataFrame:
        """The table unpivoted: one scan, one generated row a value, types and
        super-properties included. ``only`` prunes to some predicates."""
        pairs = [F.struct(F.lit(RDF + "type").alias("p"), to_term(F.lit(c), IRI).alias("o")) for c in ontology.superclasses(self.cls) if only is None or RDF + "type" in only]
        for p, (e, t) in self.columns.items():
            pairs += [F.struct(F.lit(q).alias("p"), to_term(F.expr(e), t).alias("o")) for q in ontology.superproperties(p) if only is None or q in only]
        c, t = self.subject()
        if not pairs:
            return self.df.sparkSession.createDataFrame([], QUAD_SQL)
        rows = self.df.select(self.graph_column().alias("g"), to_lex(c, t).alias("s"), F.explode(F.array(*pairs)).alias("x"))
        return rows.select("g", "s", F.col("x.p").alias("p"), F.col("x.o").alias("o")).where(F.col("o.lex").isNotNull())


def anonymous_name(columns: list[str]) -> Column:
    """The name of a row without a key; never null to the planner, which else hashes rows to see whether they have a name."""
    return F.coalesce(F.concat(F.lit("urn:bnode:"), F.sha2(F.to_json(F.struct(*columns)), 256)), F.lit("urn:bnode:"))


def digest(name: Column) -> Column:
    """The bytes in an anonymous subject's name."""
    return F.unhex(F.substr(name, F.lit(len("urn:bnode:") + 1)))


@dataclass(frozen=True)
class Delta:
    """Subjects that an update touched, and all their quads after it."""

    touched: DataFrame
    quads: DataFrame
    #: Where both are stored.
    paths: tuple[str, str]
    #: Beginnings of the touched names, as tables' subjects have them.
    starts: frozenset[str] = frozenset()


#: Deltas that a snapshot keeps before they are merged into one.
MOST_DELTAS = 8


@dataclass(frozen=True)
class Dataset:
    spark: SparkSession
    ontology: Ontology
    tables: tuple[ClassTable, ...] = ()
    stored: DataFrame | None = None
    graphs: frozenset[str] = frozenset()
    options: dict = field(default_factory=dict)
    #: What lies under the deltas: the quads first stored, where they are, and the whole tables.
    base: DataFrame | None = None
    base_path: str | None = None
    origin: tuple[ClassTable, ...] = ()
    deltas: tuple[Delta, ...] = ()
    #: Folder of a durable store; without one, tables go to the scratch folder.
    root: str | None = None
    #: Stored full-text postings; without them a match scans the texts.
    index: object | None = None
    #: Path and names of the subjects of each change of rows; None where all quads were replaced.
    moved: tuple[tuple[str | None, DataFrame | None], ...] = ()

    def quads(self, only: set[str] | None = None) -> DataFrame:
        """Every quad, or those with one of some predicates."""
        parts = [t.quads(self.ontology, only) for t in self.tables if only is None or self._has(t, only)]
        if self.stored is not None:
            parts.append(self.stored if only is None else self.stored.where(F.col("p").isin(*only)))
        if not parts:
            return self.spark.createDataFrame([], QUAD_SQL)
        return reduce(DataFrame.unionByName, parts)

    def schema(self) -> DataFrame:
        """The ontology's own triples in the default graph, a literal table in the plan."""
        text = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
        rows = ", ".join(f"({text(s)}, {text(p)}, {text(k)}, {text(o)})" for s, p, k, o in self.ontology.triples())
        df = self.spark.sql(f"select * from values {rows} as t(s, p, k, o)")
        o = F.struct(F.col("k").alias("kind"), F.col("o").alias("lex"), F.lit(None).cast("string").alias("lang"))
        return df.select(F.lit(DEFAULT_GRAPH).alias("g"), "s", "p", F.when(F.col("k").isNotNull(), o).alias("o"))

    def _has(self, t: ClassTable, only: set[str]) -> bool:
        return RDF + "type" in only or any(q in only for p in t.columns for q in self.ontology.superproperties(p))

    def named_graphs(self) -> DataFrame:
        """``g`` of every named graph that exists."""
        parts = [t.df.select(t.graph_column().alias("g")).distinct() for t in self.tables if t.graph is not None]
        if self.stored is not None:
            parts.append(self.stored.select("g").distinct())
        if self.graphs:
            parts.append(self.spark.createDataFrame([(g,) for g in sorted(self.graphs)], "g string"))
        if not parts:
            return self.spark.createDataFrame([], "g string")
        return reduce(DataFrame.union, parts).where(F.col("g") != DEFAULT_GRAPH).distinct()

    def with_quads(self, stored: DataFrame, path: str | None = None, **more) -> Dataset:
        """Other quads in place of the stored ones."""
        return replace(self, stored=stored, base=stored, base_path=path, deltas=(), origin=self.tables, index=None, moved=(*self.moved, (None, None)), **more)

    def write(self, df: DataFrame, label: str) -> tuple[DataFrame, str]:
        """``df`` as a table of this dataset's folder."""
        path = table_path(self.spark, label, self.root)
        return materialise_at(df, path), path

    def about(self, subjects: DataFrame, starts: frozenset[str] | None = None) -> DataFrame:
        """All quads of some subjects."""
        starts = self.starts(subjects)[0] if starts is None else starts
        parts = [t.holds(subjects, "left_semi").quads(self.ontology) for t in self.tables if t.start in starts]
        if self.stored is not None:
            parts.append(self.stored.join(subjects, "s", "left_semi").select("g", "s", "p", "o"))
        if not parts:
            return self.spark.createDataFrame([], QUAD_SQL)
        return reduce(DataFrame.unionByName, parts)

    def starts(self, subjects: DataFrame) -> tuple[frozenset[str], bool]:
        """Which tables some subjects may lie in, and whether there are any; one row comes back."""
        starts = sorted({t.start for t in self.tables})
        found = subjects.agg(*(F.max(F.startswith("s", F.lit(p))).alias(f"p{k}") for k, p in enumerate(starts)), F.count("*").alias("n")).first()
        return frozenset(p for k, p in enumerate(starts) if found[k]), found["n"] > 0

    def changed(self, touched: DataFrame, path: str, starts: frozenset[str], quads: DataFrame, **more) -> Dataset:
        """Touched subjects (a stored table ``s``) have just these quads from now on."""
        if self.stored is None and not self.tables:
            return self.with_quads(*self.write(quads, "quads"), **more)
        quads, at = self.write(quads, "quads")
        deltas = (*self.deltas, Delta(touched, quads, (path, at), starts))
        if len(deltas) > MOST_DELTAS:
            every = reduce(DataFrame.union, (d.touched for d in deltas))
            (t, p), (q, a) = self.write(spread(every, "s", every).distinct(), "touched"), self.write(_settled(None, deltas), "quads")
            deltas = (Delta(t, q, (p, a), frozenset().union(*(d.starts for d in deltas))),)
        return self.assembled(deltas, index=self.index.changed(touched) if self.index is not None else None, **more)

    def assembled(self, deltas: tuple[Delta, ...], **more) -> Dataset:
        """The snapshot of the base under some deltas."""
        origin = self.origin or self.tables
        if not deltas:
            return replace(self, stored=self.base, tables=origin, origin=origin, deltas=(), **more)
        touched = reduce(DataFrame.union, (d.touched for d in deltas))
        starts = frozenset().union(*(d.starts for d in deltas))
        tables = tuple(t.holds(touched, "left_anti") if t.start in starts else t for t in origin)
        return replace(self, stored=_settled(self.base, deltas), tables=tables, origin=origin, deltas=deltas, **more)

    def changed_rows(self, old: list[ClassTable], new: ClassTable, touched: DataFrame, path: str, among: Column | None = None) -> Dataset:
        """Touched subjects of some tables, all among some rows, are rows of a new one from now on; nothing is stored as quads."""
        tables = (*(t.without(touched, among) if t in old else t for t in self.tables), new)
        return replace(self, tables=tables, origin=tables, index=self.index.changed(touched) if self.index is not None else None, moved=(*self.moved, (path, touched)))

    def kept(self, condition, **more) -> Dataset:
        """Only the quads whose graph meets a condition; nothing is written."""
        tables = tuple(replace(t, df=t.df.where(condition(t.graph_column()))) for t in self.tables)
        out = replace(self, tables=tables, **more)
        return out.with_quads(self.stored.where(condition(F.col("g"))) if self.stored is not None else None)

    def flattened(self) -> Dataset:
        """The same data as quads alone, as updates need it."""
        return replace(self, tables=(), origin=()).with_quads(self.quads()) if self.tables else self


def _settled(base: DataFrame | None, deltas: tuple[Delta, ...]) -> DataFrame:
    """Quads after all deltas: each one's stand unless a later one touches their subject."""
    parts = [x for x in (base, *(d.quads for d in deltas)) if x is not None]
    later = [d.touched for d in deltas]
    out = []
    for k, part in enumerate(parts):
        after = later[len(later) - (len(parts) - 1 - k) :] if len(parts) - 1 - k else []
        part = part.join(reduce(DataFrame.union, after), "s", "left_anti") if after else part
        out.append(part.select("g", "s", "p", "o"))
    return reduce(DataFrame.union, out)
