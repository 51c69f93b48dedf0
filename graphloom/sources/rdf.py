"""RDF documents: Turtle, TriG and JSON-LD readers and writers.

One document is parsed on the driver, as its prefixes and blank nodes run
through it; many documents are parsed in parallel, a file a row.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import QUAD_SQL
from ..errors import ParseError, Unsupported
from ..parser.tokens import tokenize, unescape
from ..runtime import ship
from ..terms import range_type
from ..vocab import DEFAULT_GRAPH, RDF, XSD

Term = tuple[str, str, str | None]
Quad = tuple[str, str, Term, str | None]


def literal(lex: str, datatype: str | None = None, lang: str | None = None) -> Term:
    if lang is not None:
        return "lang", lex, lang.lower()
    kind = range_type(datatype or XSD + "string").kind
    return ("string" if kind == "iri" else kind), lex, None


class TurtleParser:
    """Turtle and TriG, by recursive descent over the query language's tokens."""

    def __init__(self, text: str, base: str = "", salt: str = ""):
        self.tokens = tokenize(_comments_kept(text))
        self.at, self.base, self.salt = 0, base, salt
        self.prefixes: dict[str, str] = {}
        self.fresh = itertools.count()
        self.out: list[Quad] = []
        self.graph: str | None = None

    def fail(self, wanted: str):
        raise ParseError(f"expected {wanted}, found {self.tokens[self.at].text!r}")

    def op(self, text: str) -> bool:
        t = self.tokens[self.at]
        if t.kind == "op" and t.text == text:
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.op(text):
            self.fail(repr(text))

    def parse(self) -> list[Quad]:
        while (t := self.tokens[self.at]).kind != "end":
            word = t.text.lower().lstrip("@")
            if t.kind in ("lang", "word") and word in ("prefix", "base"):
                self.at += 1
                if word == "prefix":
                    name = self.tokens[self.at].text
                    if not name.endswith(":"):
                        self.fail("a prefix")
                    self.at += 1
                    self.prefixes[name[:-1]] = self.iri()
                else:
                    self.base = self.iri()
                if t.text.startswith("@"):
                    self.need(".")
            elif t.kind == "word" and word == "graph":
                self.at += 1
                self.block(self.iri())
            elif self.op("{"):
                self.at -= 1
                self.block(None)
            elif t.kind in ("iri", "pname") and self.tokens[self.at + 1].text == "{":
                self.block(self.iri())
            else:
                self.triples()
                self.need(".")
        return self.out

    def block(self, graph: str | None) -> None:
        self.need("{")
        self.graph = graph
        while not self.op("}"):
            self.triples()
            self.op(".")
        self.graph = None

    def iri(self) -> str:
        t = self.tokens[self.at]
        self.at += 1
        if t.kind == "iri":
            iri = t.text[1:-1]
            if self.base and not re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", iri):
                from urllib.parse import urljoin

                return urljoin(self.base, iri) + "#" * (iri.endswith("#") and "#" not in urljoin(self.base, iri)) if iri else self.base
            return iri
        if t.kind == "pname":
            prefix, _, local = t.text.partition(":")
            if prefix in self.prefixes:
                return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        self.at -= 1
        return self.fail("an IRI")

    def blank(self, label: str | None = None) -> str:
        return f"urn:bnode:{self.salt}{label if label is not None else f'.{next(self.fresh)}'}"

    def triples(self) -> None:
        if self.op("["):
            s = self.blank()
            if not self.op("]"):
                self.properties(s)
                self.need("]")
            t = self.tokens[self.at]
            if t.text in (".", "}"):
                return
        else:
            s = self.object()[1]
        self.properties(s)

    def properties(self, s: str) -> None:
        while True:
            t = self.tokens[self.at]
            if t.kind == "word" and t.text == "a":
                self.at += 1
                p = RDF + "type"
            else:
                p = self.iri()
            while True:
                self.out.append((s, p, self.object(), self.graph))
                if not self.op(","):
                    break
            more = False
            while self.op(";"):
                more = True
            if not more or self.tokens[self.at].text in (".", "]", "}"):
                return

    def object(self) -> Term:
        t = self.tokens[self.at]
        if t.kind == "op" and t.text == "[":
            self.at += 1
            node = self.blank()
            if not self.op("]"):
                self.properties(node)
                self.need("]")
            return "iri", node, None
        if t.kind == "op" and t.text == "(":
            self.at += 1
            items = []
            while not self.op(")"):
                items.append(self.object())
            cells = [self.blank() for _ in items] + [RDF + "nil"]
            for k, x in enumerate(items):
                self.out.append((cells[k], RDF + "first", x, self.graph))
                self.out.append((cells[k], RDF + "rest", ("iri", cells[k + 1], None), self.graph))
            return "iri", cells[0], None
        if t.kind == "bnode":
            self.at += 1
            return "iri", self.blank(t.text[2:]), None
        if t.kind in ("iri", "pname"):
            return "iri", self.iri(), None
        if t.kind == "string":
            self.at += 1
            lex = unescape(t.text[3:-3] if t.text[:3] in ('"""', "'''") and len(t.text) >= 6 else t.text[1:-1])
            if self.tokens[self.at].kind == "lang":
                self.at += 1
                return literal(lex, lang=self.tokens[self.at - 1].text[1:])
            return literal(lex, self.iri()) if self.op("^^") else literal(lex)
        sign = ""
        if t.text in ("+", "-"):
            self.at += 1
            sign, t = t.text.replace("+", ""), self.tokens[self.at]
        if t.kind in ("integer", "decimal", "double"):
            self.at += 1
            return literal(sign + t.text, XSD + ("integer" if t.kind == "integer" else "double"))
        if t.kind == "word" and t.text in ("true", "false"):
            self.at += 1
            return literal(t.text, XSD + "boolean")
        return self.fail("a term")


def _comments_kept(text: str) -> str:
    return text.lstrip("\ufeff")


def parse_turtle(text: str, base: str = "", salt: str = "") -> list[Quad]:
    return TurtleParser(text, base, salt).parse()


def parse_jsonld(text: str, salt: str = "") -> list[Quad]:
    """The subset with @context (prefixes, terms, types), @graph, @id, @type, @value, @list."""
    try:
        doc = json.loads(text)
    except ValueError as e:
        raise ParseError(f"no JSON: {e}") from None
    out: list[Quad] = []
    fresh = itertools.count()

    def expand(name: str, ctx: dict) -> str:
        d = ctx.get(name)
        if isinstance(d, dict):
            d = d.get("@id")
        if d:
            return expand(d, {k: v for k, v in ctx.items() if k != name})
        prefix, colon, local = name.partition(":")
        if colon and prefix in ctx and not local.startswith("//"):
            base = ctx[prefix]
            return (base["@id"] if isinstance(base, dict) else base) + local
        return name if colon else ctx.get("@vocab", "") + name

    def value(v, ctx: dict, graph, kind: str | None = None) -> Term:
        if isinstance(v, dict):
            if "@value" in v:
                x = v["@value"]
                if "@language" in v:
                    return literal(str(x), lang=v["@language"])
                return literal(str(x), expand(v["@type"], ctx)) if "@type" in v else value(x, ctx, graph)
            if "@list" in v:
                items = [value(x, ctx, graph) for x in v["@list"]]
                cells = [f"urn:bnode:{salt}.{next(fresh)}" for _ in items] + [RDF + "nil"]
                for k, x in enumerate(items):
                    out.append((cells[k], RDF + "first", x, graph))
                    out.append((cells[k], RDF + "rest", ("iri", cells[k + 1], None), graph))
                return "iri", cells[0], None
            return "iri", node(v, ctx, graph), None
        if isinstance(v, bool):
            return literal(str(v).lower(), XSD + "boolean")
        if isinstance(v, int):
            return literal(str(v), XSD + "integer")
        if isinstance(v, float):
            return literal(repr(v), XSD + "double")
        if kind == "@id":
            return "iri", name_of(v, ctx), None
        return literal(str(v), expand(kind, ctx)) if kind else literal(str(v))

    def name_of(x: str, ctx: dict) -> str:
        return f"urn:bnode:{salt}{x[2:]}" if x.startswith("_:") else expand(x, ctx)

    def node(n: dict, ctx: dict, graph: str | None) -> str:
        if "@context" in n:
            ctx = ctx | _context(n["@context"])
        s = name_of(n["@id"], ctx) if "@id" in n else f"urn:bnode:{salt}.{next(fresh)}"
        if "@graph" in n:
            inner = s if "@id" in n else graph
            for x in n["@graph"] if isinstance(n["@graph"], list) else [n["@graph"]]:
                node(x, ctx, inner)
        for k, vs in n.items():
            if k in ("@context", "@id", "@graph"):
                continue
            for v in vs if isinstance(vs, list) else [vs]:
                if k == "@type":
                    out.append((s, RDF + "type", ("iri", expand(v, ctx), None), graph))
                elif not k.startswith("@"):
                    d = ctx.get(k)
                    out.append((s, expand(k, ctx), value(v, ctx, graph, d.get("@type") if isinstance(d, dict) else None), graph))
        return s

    def _context(c) -> dict:
        if isinstance(c, list):
            out = {}
            for x in c:
                out |= _context(x)
            return out
        if not isinstance(c, dict):
            raise Unsupported("a remote context")
        return c

    for n in doc if isinstance(doc, list) else [doc]:
        node(n, {}, None)
    return out


_FORMATS = {"ttl": "turtle", "turtle": "turtle", "nt": "turtle", "trig": "trig", "nq": "trig", "jsonld": "json-ld", "json": "json-ld", "ontology": "turtle", "rq": "turtle", "txt": "turtle"}


def format_of(path: str) -> str:
    end = path.rsplit(".", 1)[-1].lower()
    if end not in _FORMATS:
        raise Unsupported(f"no reader for .{end}")
    return _FORMATS[end]


def parse(text: str, fmt: str, base: str = "", salt: str = "") -> list[Quad]:
    return parse_jsonld(text, salt) if fmt == "json-ld" else parse_turtle(text, base, salt)


def to_frame(spark: SparkSession, quads: list[Quad], graph: str | None = None) -> DataFrame:
    return spark.createDataFrame([(g or graph or DEFAULT_GRAPH, s, p, o) for s, p, o, g in quads], QUAD_SQL)


def read_quads(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    """Quads of every document under a path or glob, parsed where the files are read.

    Malformed documents fail with a ParseError's text; blank nodes are kept
    apart by file.
    """
    ship(spark)
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, text in zip(pdf["path"], pdf["value"]):
                salt = f"{abs(hash_text(file)):x}-"
                rows += [(g or graph or DEFAULT_GRAPH, s, p, {"kind": o[0], "lex": o[1], "lang": o[2]}) for s, p, o, g in parse(text, format_of(file), salt=salt)]
            yield pd.DataFrame(rows, columns=["g", "s", "p", "o"])

    return files.mapInPandas(run, QUAD_SQL)


def read_ontology(spark: SparkSession, path: str):
    """The ontology that some documents declare; its size is that of a schema."""
    from ..ontology import Ontology

    return Ontology.from_quads([(r["s"], r["p"], tuple(r["o"]), r["g"]) for r in read_quads(spark, path).collect()])


def hash_text(text: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


# -- writers


def _turtle_term(kind: str, lex: str, lang: str | None) -> str:
    if kind in ("iri", "bnode"):
        return f"_:{re.sub(r'[^A-Za-z0-9]', '_', lex[10:])}" if lex.startswith("urn:bnode:") else f"<{lex}>"
    text = '"' + lex.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'
    if kind == "lang":
        return f"{text}@{lang}"
    return text if kind == "string" else f"{text}^^<{XSD}{kind}>"


def turtle_lines(quads: DataFrame) -> DataFrame:
    """One N-Triples-style Turtle line a quad, written where the rows are."""
    escaped = F.col("o.lex")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    quoted = F.concat(F.lit('"'), escaped, F.lit('"'))
    node = lambda c: F.when(F.startswith(c, F.lit("urn:bnode:")), F.concat(F.lit("_:"), F.regexp_replace(F.substr(c, F.lit(11)), "[^A-Za-z0-9]", "_"))).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    k = F.col("o.kind")
    o = F.when(k.isin("iri", "bnode"), node(F.col("o.lex"))).when(k == "lang", F.concat(quoted, F.lit("@"), F.col("o.lang"))).when(k == "string", quoted).otherwise(F.concat(quoted, F.lit(f"^^<{XSD}"), k, F.lit(">")))
    return quads.select(F.concat_ws(" ", node(F.col("s")), node(F.col("p")), o, F.lit(".")).alias("value"), "g")


def to_turtle(rows: list) -> str:
    """A Turtle document out of collected quads (g, s, p, o), subjects gathered."""
    subjects: dict[str, list[str]] = {}
    for _, s, p, o in rows:
        subjects.setdefault(_turtle_term("iri", s, None), []).append(f"{_turtle_term('iri', p, None)} {_turtle_term(*o)}")
    return "".join(f"{s} {' ;\n  '.join(po)} .\n" for s, po in subjects.items())


def to_trig(rows: list) -> str:
    graphs: dict[str, list] = {}
    for r in rows:
        graphs.setdefault(r[0], []).append(r)
    return "".join(to_turtle(part) if g == DEFAULT_GRAPH else f"<{g}> {{\n{to_turtle(part)}}}\n" for g, part in sorted(graphs.items()))


def to_jsonld(rows: list) -> str:
    graphs: dict[str, dict[str, dict]] = {}
    for g, s, p, (kind, lex, lang) in rows:
        name = f"_:{re.sub(r'[^A-Za-z0-9]', '_', s[10:])}" if s.startswith("urn:bnode:") else s
        n = graphs.setdefault(g, {}).setdefault(name, {"@id": name})
        if p == RDF + "type":
            n.setdefault("@type", []).append(lex)
            continue
        if kind in ("iri", "bnode"):
            v: dict = {"@id": f"_:{re.sub(r'[^A-Za-z0-9]', '_', lex[10:])}" if lex.startswith("urn:bnode:") else lex}
        elif kind == "lang":
            v = {"@value": lex, "@language": lang}
        else:
            v = {"@value": lex} if kind == "string" else {"@value": lex, "@type": XSD + kind}
        n.setdefault(p, []).append(v)
    out: list = []
    for g, nodes in sorted(graphs.items()):
        out += list(nodes.values()) if g == DEFAULT_GRAPH else [{"@id": g, "@graph": list(nodes.values())}]
    return json.dumps(out, ensure_ascii=False, indent=1)
