"""Scalar functions: name to a builder over typed columns.

A builder takes [(Column, T), …] and gives (Column, T). All run as JVM
expressions but IRI(), case folding and normalisation, which are Arrow UDFs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..errors import ParseError, TypeMismatch
from ..terms import BOOLEAN, DATATYPES, DATETIME, DOUBLE, INTEGER, IRI, LANG, STRING, TERM, T, convert, equal, null, range_type, to_lex, truth, wall, zone_suffix
from ..vocab import FN, GL, INTEGERS, RDF, XSD

Arg = tuple[Column, T]
Builder = Callable[[list[Arg]], Arg]
REGISTRY: dict[str, tuple[Builder, int, int | None]] = {}


def register(*names: str, low: int = 1, high: int | None = 1):
    def add(f: Builder) -> Builder:
        for n in names:
            REGISTRY[n] = (f, low, high)
        return f

    return add


def build(name: str, args: list[Arg]) -> Arg:
    if name not in REGISTRY:
        raise ParseError(f"unknown function {name}")
    f, low, high = REGISTRY[name]
    if len(args) < low or high is not None and len(args) > high:
        raise ParseError(f"{name} takes {low} to {high} arguments, not {len(args)}")
    return f(args)


def lex(a: Arg) -> Column:
    return to_lex(*a)


def number(a: Arg) -> Column:
    return a[0] if a[1].numeric else convert(*a, DOUBLE)


def constant(c: Column) -> str | None:
    """The text of a string literal column, None for anything else."""
    node = c._jc.node() if hasattr(c._jc, "node") else None
    if node is None or node.getClass().getSimpleName() != "Literal":
        return None
    value = node.value()
    return value if isinstance(value, str) else None


# -- strings


def _like(a: Arg, c: Column) -> Arg:
    """Result of a string function keeps the language of its argument."""
    return (F.when(a[0].isNotNull(), F.struct(c.alias("value"), a[0]["lang"].alias("lang"))), LANG) if a[1].kind == "lang" else (c, STRING)


REGISTRY |= {
    "STRLEN": (lambda a: (F.length(lex(a[0])).cast("bigint"), INTEGER), 1, 1),
    "UCASE": (lambda a: _like(a[0], F.upper(lex(a[0]))), 1, 1),
    "LCASE": (lambda a: _like(a[0], F.lower(lex(a[0]))), 1, 1),
    "CONTAINS": (lambda a: (F.contains(lex(a[0]), lex(a[1])), BOOLEAN), 2, 2),
    "STRSTARTS": (lambda a: (F.startswith(lex(a[0]), lex(a[1])), BOOLEAN), 2, 2),
    "STRENDS": (lambda a: (F.endswith(lex(a[0]), lex(a[1])), BOOLEAN), 2, 2),
    "MD5": (lambda a: (F.md5(lex(a[0])), STRING), 1, 1),
    "SHA1": (lambda a: (F.sha1(lex(a[0])), STRING), 1, 1),
    "SHA256": (lambda a: (F.sha2(lex(a[0]), 256), STRING), 1, 1),
    "SHA384": (lambda a: (F.sha2(lex(a[0]), 384), STRING), 1, 1),
    "SHA512": (lambda a: (F.sha2(lex(a[0]), 512), STRING), 1, 1),
    "ENCODE_FOR_URI": (lambda a: (F.replace(F.replace(F.replace(F.url_encode(lex(a[0])), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")), STRING), 1, 1),
    "CONCAT": (lambda a: (F.concat(F.lit(""), *map(lex, a)), STRING), 0, None),
}


@register("STRBEFORE", low=2, high=2)
def _before(a: list[Arg]) -> Arg:
    s, n = lex(a[0]), lex(a[1])
    at = F.position(n, s)
    return _like(a[0], F.when(at > 0, F.substr(s, F.lit(1), at - 1)).when(s.isNotNull() & n.isNotNull(), F.lit("")))


@register("STRAFTER", low=2, high=2)
def _after(a: list[Arg]) -> Arg:
    s, n = lex(a[0]), lex(a[1])
    at = F.position(n, s)
    return _like(a[0], F.when(F.length(n) == 0, s).when(at > 0, F.substr(s, at + F.length(n))).when(s.isNotNull() & n.isNotNull(), F.lit("")))


@register("SUBSTR", low=2, high=3)
def _substr(a: list[Arg]) -> Arg:
    """1-based start and a length; positions below 1 count but hold nothing."""
    s, start = lex(a[0]), number(a[1]).cast("int")
    first = F.greatest(start, F.lit(1))
    if len(a) == 2:
        return _like(a[0], F.substr(s, first))
    size = number(a[2]).cast("int")
    return _like(a[0], F.when(start + size > first, F.substr(s, first, start + size - first)).when(s.isNotNull() & start.isNotNull() & size.isNotNull(), F.lit("")))


def _flags(a: Arg | None) -> str:
    if a is None:
        return ""
    flags = constant(a[0])
    if flags is None or not set(flags) <= set("smix"):
        raise ParseError("flags are a constant of s, m, i and x")
    return f"(?{flags})" if flags else ""


@register("REGEX", low=2, high=3)
def _regex(a: list[Arg]) -> Arg:
    flags = _flags(a[2] if len(a) > 2 else None)
    pattern = constant(a[1][0])
    if pattern is not None:
        try:
            re.compile(pattern.replace("\\p{", "[") if "\\p{" in pattern else pattern)
        except re.error as e:
            if "\\p" not in pattern:
                raise ParseError(f"bad pattern {pattern!r}: {e}") from None
    return F.coalesce(F.rlike(lex(a[0]), F.concat(F.lit(flags), lex(a[1])) if flags else lex(a[1])), F.lit(False)), BOOLEAN


@register("REPLACE", low=3, high=4)
def _replace(a: list[Arg]) -> Arg:
    flags = _flags(a[3] if len(a) > 3 else None)
    pattern = constant(a[1][0])
    if pattern is not None:
        try:
            if re.fullmatch(pattern, "") or re.match(pattern, ""):
                raise ParseError("the pattern matches the empty string")
        except re.error:
            pass
    return _like(a[0], F.regexp_replace(lex(a[0]), F.concat(F.lit(flags), lex(a[1])), lex(a[2])))


def string_join(items: list[Arg], sep: Arg) -> Arg:
    """Texts joined, unbound ones left out."""
    kept = F.filter(F.array(*map(lex, items)), lambda x: x.isNotNull())
    return F.array_join(kept, constant(sep[0]) or ""), STRING


# -- terms


@register("STR")
def _str(a: list[Arg]) -> Arg:
    return lex(a[0]), STRING


@register("DATATYPE")
def _datatype(a: list[Arg]) -> Arg:
    c, t = a[0]
    if t.kind == "term":
        kind = c["kind"]
        out = null(STRING)
        for k, iri in DATATYPES.items():
            out = F.when(kind == k, F.lit(iri)).otherwise(out)
        return out, IRI
    return (F.when(c.isNotNull(), F.lit(DATATYPES[t.kind])) if t.kind in DATATYPES else null(IRI)), IRI


@register("LANG")
def _lang(a: list[Arg]) -> Arg:
    c, t = a[0]
    if t.kind == "lang":
        return c["lang"], STRING
    if t.kind == "term":
        return F.when(c["kind"].isin("iri", "bnode"), null(STRING)).otherwise(F.coalesce(c["lang"], F.lit(""))), STRING
    return (null(STRING) if t.resource else F.when(c.isNotNull(), F.lit(""))), STRING


@register("LANGMATCHES", low=2, high=2)
def _langmatches(a: list[Arg]) -> Arg:
    """First argument is a tag or a literal that has one; "*" and ranges as in RFC 4647."""
    tag = _lang([a[0]])[0] if a[0][1].kind in ("lang", "term") else lex(a[0])
    tag, wanted = F.lower(tag), F.lower(lex(a[1]))
    return F.when(wanted == "*", F.length(tag) > 0).otherwise((tag == wanted) | F.startswith(tag, F.concat(wanted, F.lit("-")))), BOOLEAN


def _kind_test(kinds: set[str]):
    def test(a: list[Arg]) -> Arg:
        c, t = a[0]
        if t.kind == "term":
            return c["kind"].isin(*kinds), BOOLEAN
        return F.when(c.isNotNull(), F.lit(("iri" if t.kind == "key" else t.kind) in kinds)), BOOLEAN

    return test


REGISTRY |= {
    "ISIRI": (_kind_test({"iri", "bnode"}), 1, 1),
    "ISURI": (_kind_test({"iri", "bnode"}), 1, 1),
    "ISBLANK": (_kind_test({"bnode"}), 1, 1),
    "ISLITERAL": (_kind_test(set(DATATYPES)), 1, 1),
    "ISNUMERIC": (_kind_test({"integer", "double"}), 1, 1),
    "SAMETERM": (lambda a: (equal(*a[0], *a[1]), BOOLEAN), 2, 2),
    "BOUND": (lambda a: (a[0][0].isNotNull(), BOOLEAN), 1, 1),
    "UUID": (lambda a: (F.concat(F.lit("urn:uuid:"), F.uuid()), IRI), 0, 0),
    "STRUUID": (lambda a: (F.uuid(), STRING), 0, 0),
    "BNODE": (lambda a: (F.concat(F.lit("urn:bnode:"), F.uuid()), T("bnode")), 0, 1),
    "RAND": (lambda a: (F.rand(), DOUBLE), 0, 0),
}


@F.pandas_udf(StringType())
def _escaped_iri(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else quote(x, safe="/:?#[]@!$&'()*+,;=%-._~"))


@register("IRI", "URI")
def _iri(a: list[Arg]) -> Arg:
    return (lex(a[0]), IRI) if a[0][1].resource else (_escaped_iri(lex(a[0])), IRI)


@register("STRLANG", low=2, high=2)
def _strlang(a: list[Arg]) -> Arg:
    return F.when(lex(a[0]).isNotNull(), F.struct(lex(a[0]).alias("value"), F.lower(lex(a[1])).alias("lang"))), LANG


def cast(a: Arg, datatype: str) -> Arg:
    """Cast of a term; what cannot be cast is unbound."""
    c, t = a
    to = range_type(datatype)
    if to is IRI:
        raise TypeMismatch(f"no cast to {datatype}")
    if t == to:
        return a
    if to is STRING:
        return lex(a), STRING
    if to is INTEGER and (t.kind == "double"):
        return c.try_cast("bigint"), INTEGER
    if to is INTEGER:
        return F.coalesce(lex(a).try_cast("bigint"), F.when(lex(a).try_cast("double").isNotNull() & lex(a).contains("."), lex(a).try_cast("double").try_cast("bigint"))) if t.kind != "boolean" else c.cast("bigint"), INTEGER
    if to is DOUBLE:
        return c.cast("double") if t.kind in ("integer", "boolean") else lex(a).try_cast("double"), DOUBLE
    if to is BOOLEAN:
        return (c != 0 if t.numeric else F.when(lex(a).isin("true", "1"), True).when(lex(a).isin("false", "0"), False)), BOOLEAN
    if to is LANG:
        return F.when(lex(a).isNotNull(), F.struct(lex(a).alias("value"), F.lit("").alias("lang"))), LANG
    if to is DATETIME and t.kind == "date":
        return convert(c, t, to), to
    from ..terms import parse_datetime

    return (parse_datetime(lex(a)), DATETIME) if to is DATETIME else (F.substring(lex(a), 1, 10).try_cast("date"), to)


for _type in ("string", "boolean", "double", "date", "dateTime"):
    REGISTRY[XSD + _type] = (lambda a, d=XSD + _type: cast(a[0], d), 1, 1)
for _type in INTEGERS:
    REGISTRY[_type] = (lambda a, d=XSD + "integer": cast(a[0], d), 1, 1)
REGISTRY[RDF + "langString"] = (lambda a: cast(a[0], RDF + "langString"), 1, 1)


@register("STRDT", low=2, high=2)
def _strdt(a: list[Arg]) -> Arg:
    iri = constant(a[1][0])
    if iri is None:
        raise ParseError("STRDT takes a constant datatype")
    return cast((lex(a[0]), STRING), iri)


# -- control


@register("IF", low=3, high=3)
def _if(a: list[Arg]) -> Arg:
    from ..terms import common

    t = common(a[1][1], a[2][1])
    c = truth(*a[0])
    return F.when(c, convert(*a[1], t)).when(~c, convert(*a[2], t)), t


@register("COALESCE", GL + "coalesce", low=1, high=None)
def _coalesce(a: list[Arg]) -> Arg:
    from ..terms import common

    t = a[0][1]
    for _, x in a[1:]:
        t = common(t, x)
    return F.coalesce(*(convert(c, x, t) for c, x in a)), t


# -- numbers

REGISTRY |= {
    "ABS": (lambda a: (F.abs(number(a[0])), a[0][1] if a[0][1].numeric else DOUBLE), 1, 1),
    "CEIL": (lambda a: (F.ceil(number(a[0])).cast("double"), DOUBLE), 1, 1),
    "FLOOR": (lambda a: (F.floor(number(a[0])).cast("double"), DOUBLE), 1, 1),
    "ROUND": (lambda a: (a[0] if a[0][1] is INTEGER else (F.round(number(a[0])), DOUBLE)), 1, 1),
}
_RADIUS = 6371000.0


@register(GL + "cartesian-distance", low=4, high=4)
def _flat(a: list[Arg]) -> Arg:
    """Arguments are lat, lat, lon, lon, in degrees; polar flat-earth formula, metres."""
    lat1, lat2, lon1, lon2 = (F.radians(number(x)) for x in a)
    p, q = F.lit(3.141592653589793 / 2) - lat1, F.lit(3.141592653589793 / 2) - lat2
    return F.sqrt(p * p + q * q - 2 * p * q * F.cos(lon2 - lon1)) * _RADIUS, DOUBLE


@register(GL + "haversine-distance", low=4, high=4)
def _haversine(a: list[Arg]) -> Arg:
    lat1, lat2, lon1, lon2 = (F.radians(number(x)) for x in a)
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return F.asin(F.least(F.lit(1.0), F.sqrt(h))) * (2 * _RADIUS), DOUBLE


# -- dates


def _stamp(a: Arg) -> Column:
    return convert(*a, DATETIME) if a[1] is not DATETIME else a[0]


def _part(f) -> Builder:
    return lambda a: (f(wall(_stamp(a[0]))).cast("bigint"), INTEGER)


for _names, _f in ((("YEAR", FN + "year-from-dateTime"), F.year), (("MONTH", FN + "month-from-dateTime"), F.month), (("DAY", FN + "day-from-dateTime"), F.dayofmonth), (("HOURS", FN + "hours-from-dateTime"), F.hour), (("MINUTES", FN + "minutes-from-dateTime"), F.minute)):
    register(*_names)(_part(_f))


@register("SECONDS", FN + "seconds-from-dateTime")
def _seconds(a: list[Arg]) -> Arg:
    w = wall(_stamp(a[0]))
    return F.expr("0D") + F.date_part(F.lit("SECOND"), w).cast("double"), DOUBLE


@register("TZ")
def _tz(a: list[Arg]) -> Arg:
    return zone_suffix(_stamp(a[0])), STRING


@register("TIMEZONE")
def _timezone(a: list[Arg]) -> Arg:
    off = _stamp(a[0])["off"]
    h, m = F.floor(F.abs(off) / 3600), F.floor(F.abs(off) / 60) % 60
    out = F.concat(F.when(off < 0, "-").otherwise(""), F.lit("PT"), F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""))
    return F.when(off == 0, F.lit("PT0S")).when(off.isNotNull(), out), STRING


@register(FN + "timezone-from-dateTime")
def _offset(a: list[Arg]) -> Arg:
    """Offset from UTC in seconds."""
    return _stamp(a[0])["off"].cast("bigint"), INTEGER


@register("NOW", low=0, high=0)
def _now(a: list[Arg]) -> Arg:
    return F.struct(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz").alias("ts"), F.lit(0).alias("off")), DATETIME


# -- the library's own functions


@F.pandas_udf(StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.casefold())


def _normalised(form: str):
    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return run


@F.pandas_udf(StringType())
def _unaccented(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


@register(GL + "normalize", low=2, high=2)
def _normalize(a: list[Arg]) -> Arg:
    form = (constant(a[1][0]) or "").upper()
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ParseError("normalize takes nfc, nfd, nfkc or nfkd")
    return _normalised(form)(lex(a[0])), STRING


def title_key(c: Column) -> Column:
    """Sort key of a title: no leading article or punctuation."""
    return F.regexp_replace(F.lower(c), r"^[\p{P}\s]*(?:(?:the|an|a)\s+)?[\p{P}\s]*", "")


@register(GL + "uri-is-parent", low=2, high=2)
def _is_parent(a: list[Arg]) -> Arg:
    parent, uri = F.regexp_replace(lex(a[0]), "/+$", ""), F.regexp_replace(lex(a[1]), "/+$", "")
    rest = F.substr(uri, F.length(parent) + 2)
    return F.contains(parent, F.lit("://")) & F.startswith(uri, F.concat(parent, F.lit("/"))) & (F.length(rest) > 0) & ~F.contains(rest, F.lit("/")), BOOLEAN


@register(GL + "uri-is-descendant", low=2, high=None)
def _is_descendant(a: list[Arg]) -> Arg:
    uri, out = F.regexp_replace(lex(a[-1]), "/+$", ""), F.lit(False)
    for p in a[:-1]:
        parent = F.regexp_replace(lex(p), "/+$", "")
        out = out | (F.contains(parent, F.lit("://")) & F.startswith(uri, F.concat(parent, F.lit("/"))))
    return out, BOOLEAN


REGISTRY |= {
    GL + "case-fold": (lambda a: (_folded(lex(a[0])), STRING), 1, 1),
    GL + "unaccent": (lambda a: (_unaccented(lex(a[0])), STRING), 1, 1),
    GL + "ascii-lower-case": (lambda a: (F.translate(lex(a[0]), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), STRING), 1, 1),
    GL + "strip-punctuation": (lambda a: (F.regexp_replace(lex(a[0]), r"\p{P}", ""), STRING), 1, 1),
    GL + "title-order": (lambda a: (title_key(lex(a[0])), STRING), 1, 1),
    GL + "string-from-filename": (lambda a: (F.regexp_replace(F.regexp_replace(F.regexp_replace(lex(a[0]), r"^.*/", ""), r"(?<=.)\.[^.]*$", ""), r"[._]", " "), STRING), 1, 1),
    FN + "lower-case": REGISTRY["LCASE"],
    FN + "upper-case": REGISTRY["UCASE"],
    FN + "contains": REGISTRY["CONTAINS"],
    FN + "starts-with": REGISTRY["STRSTARTS"],
    FN + "ends-with": REGISTRY["STRENDS"],
    FN + "substring": REGISTRY["SUBSTR"],
    FN + "concat": REGISTRY["CONCAT"],
    FN + "replace": REGISTRY["REPLACE"],
}
#: A resource's id is a stable 63-bit hash of its IRI.
REGISTRY[GL + "id"] = (lambda a: (F.xxhash64(lex(a[0])).bitwiseAND(F.lit((1 << 63) - 1)), INTEGER), 1, 1)
