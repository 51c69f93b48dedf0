"""Typed columns.

A variable whose type is known at compile time is a plain column: ``key``
(the raw key of an IRI with a fixed prefix), ``iri``, ``bnode``, ``string``,
``boolean``, ``integer``, ``double``, ``date``, ``dateTime``
(struct ts timestamp_ntz in UTC, off seconds) and ``lang`` (struct value, lang).
Only where the type varies by row is it a ``term``: struct kind, lex, lang.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import TypeMismatch
from .vocab import INTEGERS, RDF, XSD


@dataclass(frozen=True)
class T:
    """``raw`` is the SQL type of a raw key; it follows from the prefix."""

    kind: str
    prefix: str = ""
    raw: str = field(default="bigint", compare=False)

    @property
    def numeric(self) -> bool:
        return self.kind in ("integer", "double")

    @property
    def resource(self) -> bool:
        return self.kind in ("key", "iri", "bnode")


IRI, BNODE, STRING, BOOLEAN, INTEGER, DOUBLE, DATE, DATETIME, LANG, TERM, NULL = (T(k) for k in "iri bnode string boolean integer double date dateTime lang term null".split())
#: A row of a class table itself (struct id, row) in place of its subject, in updates that meet it nowhere else.
ROW = T("row")

TERM_SQL = "struct<kind:string,lex:string,lang:string>"
SQL_TYPES = {"iri": "string", "bnode": "string", "string": "string", "boolean": "boolean", "integer": "bigint", "double": "double", "date": "date", "dateTime": "struct<ts:timestamp_ntz,off:int>", "lang": "struct<value:string,lang:string>", "term": TERM_SQL, "null": "string"}

DATATYPES = {"string": XSD + "string", "boolean": XSD + "boolean", "integer": XSD + "integer", "double": XSD + "double", "date": XSD + "date", "dateTime": XSD + "dateTime", "lang": RDF + "langString"}


def range_type(iri: str) -> T:
    """Static type of a property's range; classes are resources."""
    if iri in INTEGERS:
        return INTEGER
    return {XSD + "string": STRING, XSD + "boolean": BOOLEAN, XSD + "double": DOUBLE, XSD + "float": DOUBLE, XSD + "decimal": DOUBLE, XSD + "date": DATE, XSD + "dateTime": DATETIME, RDF + "langString": LANG}.get(iri, IRI)


def null(t: T = NULL) -> Column:
    return F.lit(None).cast(SQL_TYPES.get(t.kind, "string"))


def parse_datetime(lex: Column) -> Column:
    """ISO 8601 text to (UTC, offset); no zone means UTC."""
    zone = F.regexp_extract(lex, r"T.*?(Z|[+-]\d\d:?\d\d)$", 1)
    digits = F.regexp_replace(zone, r"[^0-9]", "")
    size = F.coalesce(F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60, F.lit(0))
    off = F.when(F.startswith(zone, F.lit("-")), -size).otherwise(size).cast("int")
    wall = F.regexp_replace(F.regexp_replace(lex, r"(Z|[+-]\d\d:?\d\d)$", ""), "T", " ").try_cast("timestamp_ntz")
    plain = lex.try_cast("timestamp_ntz")
    wall = F.when(lex.contains("T"), wall).otherwise(plain)
    return F.when(wall.isNotNull(), F.struct(shift(wall, -off).alias("ts"), off.alias("off")))


def shift(ts: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, ts)


def literal(lex: str, datatype: str | None, lang: str | None) -> tuple[Column, T]:
    if lang is not None:
        return F.struct(F.lit(lex).alias("value"), F.lit(lang.lower()).alias("lang")), LANG
    t = range_type(datatype or XSD + "string")
    try:
        if t is INTEGER:
            return F.lit(int(lex)).cast("bigint"), t
        if t is DOUBLE:
            return F.lit(float(lex)), t
    except ValueError:
        raise TypeMismatch(f"{lex!r} is no {datatype}") from None
    if t is BOOLEAN:
        if lex not in ("true", "false", "1", "0"):
            raise TypeMismatch(f"{lex!r} is no boolean")
        return F.lit(lex in ("true", "1")), t
    if t is DATE:
        return F.lit(lex).try_cast("date"), t
    if t is DATETIME:
        return parse_datetime(F.lit(lex)), t
    return F.lit(lex), STRING


def wall(c: Column) -> Column:
    """Local wall clock of a dateTime column."""
    return shift(c["ts"], c["off"])


def zone_suffix(c: Column) -> Column:
    size = F.abs(c["off"])
    return F.when(c["off"] == 0, F.lit("Z")).otherwise(F.concat(F.when(c["off"] < 0, "-").otherwise("+"), F.lpad((F.floor(size / 3600)).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(size / 60) % 60).cast("string"), 2, "0")))


def to_lex(c: Column, t: T) -> Column:
    """Lexical form as a string."""
    if t.kind == "key":
        return F.concat(F.lit(t.prefix), c.cast("string"))
    if t.kind in ("integer", "double", "boolean", "date"):
        return c.cast("string")
    if t.kind == "dateTime":
        w = wall(c)
        fraction = F.regexp_replace(F.date_format(w, ".SSSSSS"), r"\.?0+$", "")
        return F.concat(F.date_format(w, "yyyy-MM-dd'T'HH:mm:ss"), fraction, zone_suffix(c))
    if t.kind == "lang":
        return c["value"]
    if t.kind == "term":
        return c["lex"]
    return c.cast("string")


def to_term(c: Column, t: T) -> Column:
    if t.kind == "term":
        return c
    if t.kind == "null":
        return F.lit(None).cast(TERM_SQL)
    kind = "iri" if t.kind == "key" else t.kind
    lang = c["lang"] if t.kind == "lang" else F.lit(None).cast("string")
    return F.when(c.isNotNull(), F.struct(F.lit(kind).alias("kind"), to_lex(c, t).alias("lex"), lang.alias("lang")))


def convert(c: Column, t: T, to: T) -> Column:
    """The column as type ``to``; rows that cannot be are null."""
    if t == to:
        return c
    if t.kind == "null":
        return null(to)
    if to.kind == "term":
        return to_term(c, t)
    if to.kind == "double" and t.kind == "integer":
        return c.cast("double")
    if to.kind == "iri" and t.resource:
        return to_lex(c, t)
    if t.kind == "term":
        k, lex = c["kind"], c["lex"]
        if to.kind in ("integer", "double"):
            return F.when(k.isin("integer", "double"), lex.try_cast(SQL_TYPES[to.kind]))
        if to.kind == "iri":
            return F.when(k.isin("iri", "bnode"), lex)
        if to.kind == "dateTime":
            return F.when(k.isin("dateTime", "date"), parse_datetime(lex))
        if to.kind == "lang":
            return F.when(k == "lang", F.struct(lex.alias("value"), c["lang"].alias("lang")))
        return F.when(k == to.kind, lex.try_cast(SQL_TYPES[to.kind]))
    if to.kind == "dateTime" and t.kind == "date":
        return F.when(c.isNotNull(), F.struct(c.cast("timestamp_ntz").alias("ts"), F.lit(0).alias("off")))
    return null(to)


def common(a: T, b: T) -> T:
    """A type that holds values of both without loss: whole numbers beside doubles are terms."""
    if a == b or b.kind == "null":
        return a
    if a.kind == "null":
        return b
    if a.resource and b.resource and "bnode" not in (a.kind, b.kind):
        return IRI
    return TERM


def comparable(a: T, b: T) -> T:
    """A type in which equal values of both are equal."""
    return DOUBLE if a != b and a.numeric and b.numeric else common(a, b)


#: Whole numbers up to here are doubles without loss.
_EXACT = 1 << 53


def merged(c: Column, t: T) -> Column:
    """Key under which equal values are equal: dateTime by instant, numbers of terms by value."""
    if t.kind == "dateTime":
        return c["ts"]
    if t.kind == "term":
        whole = c["lex"].try_cast("bigint")
        number = F.when((c["kind"] == "integer") & ~whole.between(-_EXACT, _EXACT), whole.cast("string")).when(c["kind"].isin("integer", "double"), c["lex"].try_cast("double").cast("string"))
        return F.concat_ws("\x00", F.when(c["kind"].isin("integer", "double"), "number").when(c["kind"].isin("iri", "bnode"), "node").otherwise(c["kind"]), F.coalesce(number, c["lex"]), c["lang"])
    return c


def equal(a: Column, ta: T, b: Column, tb: T) -> Column:
    if "null" in (ta.kind, tb.kind):
        return F.lit(None).cast("boolean")
    if ta.kind == "lang" and tb.kind == "lang":
        return (a["value"] == b["value"]) & (a["lang"] == b["lang"])
    t = comparable(ta, tb)
    if t.kind == "term" and {ta.kind, tb.kind} == {"date", "dateTime"}:
        t = DATETIME
    x, y = convert(a, ta, t), convert(b, tb, t)
    same = merged(x, t) == merged(y, t)
    return F.when(x.isNotNull() & y.isNotNull(), same) if t.kind == "term" else same


def order_key(c: Column) -> Column:
    """Sort key of a term: nodes before literals, numbers by value, dates by instant, the rest as text."""
    k, lex = c["kind"], c["lex"]
    rank = F.when(k == "bnode", 0).when(k == "iri", 1).when(k.isin("integer", "double"), 2).when(k.isin("date", "dateTime"), 3).when(k == "boolean", 4).otherwise(5)
    return F.when(
        k.isNotNull(),
        F.struct(
            rank.alias("rank"),
            F.when(rank == 2, lex.try_cast("double")).alias("number"),
            F.when(k == "integer", lex.try_cast("bigint")).alias("whole"),
            F.when(rank == 3, parse_datetime(lex)["ts"]).alias("at"),
            F.when(rank != 2, lex).alias("text"),
        ),
    )


def _less_terms(op: str, a: Column, b: Column) -> Column:
    """Comparison of terms: numbers, dates, truth values, texts and nodes each among themselves."""
    x, y = order_key(a), order_key(b)
    group = lambda k: F.greatest(k["rank"], F.lit(1))
    whole = x["whole"].isNotNull() & y["whole"].isNotNull()

    def test(p: Column, q: Column) -> Column:
        return {"<": p < q, ">": p > q, "<=": p <= q, ">=": p >= q}[op]

    value = F.when(whole, test(x["whole"], y["whole"])).when(x["rank"] == 2, test(x["number"], y["number"])).when(x["rank"] == 3, test(x["at"], y["at"])).otherwise(test(x["text"], y["text"]))
    return F.when(group(x) == group(y), value)


def less(op: str, a: Column, ta: T, b: Column, tb: T) -> Column:
    """Order comparison; incomparable kinds are unbound."""
    if "null" in (ta.kind, tb.kind):
        return F.lit(None).cast("boolean")
    for kinds, t in ((("integer", "double"), DOUBLE), (("date", "dateTime"), DATETIME)):
        if (ta.kind in kinds or tb.kind in kinds) and (ta.kind in (*kinds, "term") and tb.kind in (*kinds, "term")):
            if ta == tb and t is DOUBLE:
                x, y = a, b
            else:
                x, y = merged(convert(a, ta, t), t), merged(convert(b, tb, t), t)
            break
    else:
        if ta.kind == "boolean" and tb.kind == "boolean":
            x, y = a, b
        elif "term" in (ta.kind, tb.kind):
            return _less_terms(op, to_term(a, ta), to_term(b, tb))
        elif ta.numeric or tb.numeric or ta.kind in ("date", "dateTime", "boolean") or tb.kind in ("date", "dateTime", "boolean"):
            return F.lit(None).cast("boolean")
        else:
            x, y = to_lex(a, ta), to_lex(b, tb)
    return {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]


def truth(c: Column, t: T) -> Column:
    """Effective boolean value."""
    if t.kind == "boolean":
        return c
    if t.numeric:
        return (c != 0) & ~F.isnan(c.cast("double"))
    if t.kind in ("string", "lang"):
        return F.length(to_lex(c, t)) > 0
    if t.kind == "term":
        k, lex = c["kind"], c["lex"]
        return F.when(k == "boolean", lex == "true").when(k.isin("integer", "double"), lex.try_cast("double") != 0).when(k.isin("string", "lang"), F.length(lex) > 0)
    return F.lit(None).cast("boolean")
