"""Recursive-descent parser for queries and updates."""

from __future__ import annotations

import itertools
import re

from ..errors import ParseError
from ..vocab import PREFIXES, RDF, XSD
from .ast import Query, Update
from .tokens import Token, tokenize, unescape

AGGREGATES = {"COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT"}
BUILTINS = {
    "STR": (1, 1), "LANG": (1, 1), "LANGMATCHES": (2, 2), "DATATYPE": (1, 1), "BOUND": (1, 1), "IRI": (1, 1), "URI": (1, 1), "BNODE": (0, 1), "RAND": (0, 0), "ABS": (1, 1),
    "CEIL": (1, 1), "FLOOR": (1, 1), "ROUND": (1, 1), "CONCAT": (0, None), "SUBSTR": (2, 3), "STRLEN": (1, 1), "REPLACE": (3, 4), "UCASE": (1, 1), "LCASE": (1, 1), "ENCODE_FOR_URI": (1, 1),
    "CONTAINS": (2, 2), "STRSTARTS": (2, 2), "STRENDS": (2, 2), "STRBEFORE": (2, 2), "STRAFTER": (2, 2), "YEAR": (1, 1), "MONTH": (1, 1), "DAY": (1, 1), "HOURS": (1, 1), "MINUTES": (1, 1),
    "SECONDS": (1, 1), "TIMEZONE": (1, 1), "TZ": (1, 1), "NOW": (0, 0), "UUID": (0, 0), "STRUUID": (0, 0), "MD5": (1, 1), "SHA1": (1, 1), "SHA256": (1, 1), "SHA384": (1, 1),
    "SHA512": (1, 1), "COALESCE": (1, None), "IF": (3, 3), "STRLANG": (2, 2), "STRDT": (2, 2), "SAMETERM": (2, 2), "ISIRI": (1, 1), "ISURI": (1, 1), "ISBLANK": (1, 1), "ISLITERAL": (1, 1),
    "ISNUMERIC": (1, 1), "REGEX": (2, 3),
}


class Parser:
    """With ``strict``, what goes beyond the standard is an error."""

    def __init__(self, text: str, prefixes: dict[str, str] | None = None, base: str = "", strict: bool = False):
        text = re.sub(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})", lambda m: chr(int(m[1] or m[2], 16)), text)
        self.text, self.tokens = text, tokenize(text)
        self.at = 0
        self.prefixes = PREFIXES | (prefixes or {})
        self.base, self.strict = base, strict
        self.fresh = itertools.count()
        self.allowed_graphs: list | None = None
        self.allowed_services: list | None = None

    # -- tokens

    @property
    def token(self) -> Token:
        return self.tokens[self.at]

    def ahead(self, k: int = 1) -> Token:
        return self.tokens[min(self.at + k, len(self.tokens) - 1)]

    def extension(self, what: str) -> None:
        if self.strict:
            raise ParseError(f"{what} is beyond strict syntax, at {self.token.at}")

    def fail(self, wanted: str):
        raise ParseError(f"expected {wanted}, found {self.token.text or 'the end'!r} at {self.token.at}")

    def next(self) -> Token:
        t = self.token
        self.at += 1
        return t

    def is_op(self, *ops: str) -> bool:
        return self.token.kind == "op" and self.token.text in ops

    def op(self, *ops: str) -> bool:
        if self.is_op(*ops):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.op(text):
            self.fail(repr(text))

    def is_word(self, *words: str) -> bool:
        return self.token.kind == "word" and self.token.text.upper() in words

    def word(self, *words: str) -> str | None:
        if self.is_word(*words):
            return self.next().text.upper()
        return None

    def need_word(self, *words: str) -> str:
        return self.word(*words) or self.fail(" or ".join(words))

    # -- prologue and dataset

    def prologue(self) -> None:
        based = bool(self.base)
        while True:
            if self.word("BASE"):
                iri = self.iri_ref()
                if not based:
                    self.base, based = iri, True
            elif self.word("PREFIX"):
                t = self.next()
                if t.kind != "pname" or not t.text.endswith(":"):
                    self.fail("a prefix")
                self.prefixes = self.prefixes | {t.text[:-1]: self.iri_ref()}
            elif self.word("CONSTRAINT"):
                self.constraint()
            else:
                return

    def constraint(self) -> None:
        self.extension("CONSTRAINT")
        kind = self.need_word("GRAPH", "SERVICE")
        names: list = []
        while True:
            if w := self.word("DEFAULT", "ALL"):
                names.append(w)
            else:
                names.append(self.iri())
            if not self.op(","):
                break
        if "ALL" in names:
            return
        attr = "allowed_graphs" if kind == "GRAPH" else "allowed_services"
        before = getattr(self, attr)
        setattr(self, attr, names if before is None else [n for n in before if n in names])

    def iri_ref(self) -> str:
        t = self.next()
        if t.kind != "iri":
            self.at -= 1
            self.fail("an IRI")
        iri = t.text[1:-1]
        if self.base and not re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", iri):
            from urllib.parse import urljoin

            return urljoin(self.base, iri) + "#" * (iri.endswith("#") and "#" not in urljoin(self.base, iri)) if iri else self.base
        return iri

    def iri(self) -> str:
        if self.token.kind == "iri":
            return self.iri_ref()
        if self.token.kind == "pname":
            prefix, _, local = self.next().text.partition(":")
            if prefix not in self.prefixes:
                raise ParseError(f"unknown prefix {prefix}:")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        return self.fail("an IRI")

    def is_iri(self) -> bool:
        return self.token.kind in ("iri", "pname")

    # -- queries

    def query(self) -> Query:
        self.prologue()
        q = self.query_body()
        if self.token.kind != "end":
            self.fail("the end")
        return q

    def query_body(self) -> Query:
        form = self.need_word("SELECT", "ASK", "CONSTRUCT", "DESCRIBE")
        q = Query(form=form.lower())
        if form == "SELECT":
            self.select_clause(q)
        elif form == "CONSTRUCT":
            if self.is_op("{"):
                q.template = self.template()
            else:
                q.template = []
        elif form == "DESCRIBE":
            if self.op("*"):
                q.star = True
            else:
                while self.token.kind == "var" or self.is_iri():
                    q.resources.append(self.var() if self.token.kind == "var" else ("iri", self.iri()))
                if not q.resources:
                    self.fail("a resource")
        self.dataset_clauses(q)
        if form == "CONSTRUCT" and not q.template:
            self.need_word("WHERE")
            q.template = self.template()
            q.where = [("triples", [t[:3] for t in q.template])]
        elif self.word("WHERE") or self.is_op("{"):
            q.where = self.group()
        elif form != "DESCRIBE":
            self.fail("a pattern")
        self.modifiers(q)
        if self.word("VALUES"):
            q.values = self.data_block()
        q.allowed_graphs, q.allowed_services = self.allowed_graphs, self.allowed_services
        return q

    def dataset_clauses(self, q: Query) -> None:
        while self.word("FROM"):
            (q.from_named if self.word("NAMED") else q.from_default).append(self.iri())

    def select_clause(self, q: Query) -> None:
        if self.word("DISTINCT"):
            q.distinct = True
        else:
            self.word("REDUCED")
        if self.op("*"):
            q.star = True
            return
        while True:
            if self.token.kind == "var" and not self._operator_follows():
                q.items.append((("term", self.var()), None))
            elif self.is_op("(") and not self._is_subselect():
                mark = self.at
                self.need("(")
                e = self.expression()
                if self.word("AS"):
                    name = self.var()[1]
                    self.need(")")
                    q.items.append((e, name))
                else:
                    self.at = mark
                    self.extension("an expression without AS")
                    q.items.append(self._loose_item())
            elif self._starts_expression():
                self.extension("an expression without parentheses")
                q.items.append(self._loose_item())
            else:
                break
            self.op(",")
        if not q.items:
            self.fail("something to select")

    def _operator_follows(self) -> bool:
        t = self.ahead()
        return t.kind == "op" and t.text in ("+", "-", "/", "=", "!=", "<", ">", "<=", ">=", "&&", "||") or t.kind == "word" and t.text.upper() in ("IN", "AS")

    def _loose_item(self):
        e = self.expression()
        return (e, self.var()[1] if self.word("AS") else None)

    def _starts_expression(self) -> bool:
        t = self.token
        if t.kind in ("string", "integer", "decimal", "double", "param", "iri", "pname", "var"):
            return True
        if t.kind == "word":
            return t.text.upper() in AGGREGATES | set(BUILTINS) | {"TRUE", "FALSE", "EXISTS", "NOT"}
        return self.is_op("(", "!", "-", "+")

    def _is_subselect(self) -> bool:
        return self.is_op("(") and self.ahead().kind == "word" and self.ahead().text.upper() == "SELECT"

    def modifiers(self, q: Query) -> None:
        if self.word("GROUP"):
            self.need_word("BY")
            while True:
                if self.op("("):
                    e = self.expression()
                    name = self.var()[1] if self.word("AS") else None
                    self.need(")")
                    q.group_by.append((e, name))
                elif self.token.kind == "var":
                    v = self.var()
                    q.group_by.append((("term", v), v[1]))
                elif self.token.kind == "word" and self.token.text.upper() in BUILTINS or self.is_iri():
                    q.group_by.append((self.primary(), None))
                else:
                    break
            if not q.group_by:
                self.fail("something to group by")
        if self.word("HAVING"):
            while self.is_op("(") or self.token.kind == "word" and self.token.text.upper() in set(BUILTINS) | AGGREGATES | {"EXISTS", "NOT"} or self.is_iri():
                q.having.append(self.expression() if not self.is_op("(") else self.primary())
            if not q.having:
                self.fail("a condition")
        if self.word("ORDER"):
            self.need_word("BY")
            while True:
                if w := self.word("ASC", "DESC"):
                    self.need("(")
                    e = self.expression()
                    self.need(")")
                    q.order_by.append((e, w == "DESC"))
                elif self.token.kind == "var":
                    q.order_by.append((("term", self.var()), False))
                elif self.is_op("(") or self._starts_expression():
                    q.order_by.append((self.primary(), False))
                else:
                    break
            if not q.order_by:
                self.fail("something to order by")
        for _ in range(2):
            if self.word("LIMIT"):
                q.limit = self.count()
            elif self.word("OFFSET"):
                q.offset = self.count()

    def count(self):
        t = self.next()
        if t.kind == "integer":
            return int(t.text)
        if t.kind == "param":
            return ("param", t.text[1:])
        self.at -= 1
        return self.fail("a number")

    # -- patterns

    def group(self) -> list:
        self.need("{")
        if self.is_word("SELECT"):
            q = self.query_body()
            self.need("}")
            return [("select", q)]
        out: list = []
        bound: set[str] = set()
        while not self.op("}"):
            if self.word("OPTIONAL"):
                out.append(("optional", self.group()))
            elif self.word("MINUS"):
                out.append(("minus", self.group()))
            elif self.word("FILTER"):
                out.append(("filter", self.primary()))
            elif self.word("BIND"):
                self.need("(")
                e = self.expression()
                self.need_word("AS")
                name = self.var()[1]
                self.need(")")
                if name in bound:
                    raise ParseError(f"?{name} is in use already")
                out.append(("bind", e, name))
            elif self.word("VALUES"):
                out.append(("values", *self.data_block()))
            elif self.word("GRAPH"):
                term = self.var() if self.token.kind == "var" else self.param() if self.token.kind == "param" else ("iri", self.iri())
                out.append(("graph", term, self.group()))
            elif self.word("SERVICE"):
                silent = bool(self.word("SILENT"))
                term = self.var() if self.token.kind == "var" else self.param() if self.token.kind == "param" else ("iri", self.iri())
                at = self.token.at
                group = self.group()
                known = "".join(f"PREFIX {p}: <{i}>\n" for p, i in self.prefixes.items())
                out.append(("service", silent, term, group, f"{known}SELECT * {self.text[at : self.tokens[self.at - 1].at + 1]}"))
            elif self.is_op("{"):
                groups = [self.group()]
                while self.word("UNION"):
                    groups.append(self.group())
                out.append(("union", groups) if len(groups) > 1 else ("group", groups[0]))
            else:
                triples = self.triples()
                if out and out[-1][0] == "triples":
                    out[-1][1].extend(triples)
                else:
                    out.append(("triples", triples))
            bound |= _names(out[-1])
            self.op(".")
        return out

    def data_block(self) -> tuple:
        def value():
            if self.word("UNDEF"):
                return None
            t = self.token
            if t.kind == "bnode":
                self.fail("a constant")
            return self.term()

        if self.token.kind == "var":
            names = [self.var()[1]]
            self.need("{")
            rows = []
            while not self.op("}"):
                rows.append((value(),))
            return names, rows
        self.need("(")
        names = []
        while not self.op(")"):
            names.append(self.var()[1])
        self.need("{")
        rows = []
        while not self.op("}"):
            self.need("(")
            row = []
            while not self.op(")"):
                row.append(value())
            if len(row) != len(names):
                raise ParseError(f"{len(names)} variables but {len(row)} values")
            rows.append(tuple(row))
        return names, rows

    def triples(self) -> list:
        """Triples of one subject with all its predicates and objects."""
        out: list = []
        if self.is_op("["):
            subject = self.blank_properties(out)
            if not (self.is_op(".", "}") or self.token.kind == "end"):
                self.property_list(subject, out)
        elif self.is_op("("):
            subject = self.collection(out)
            if not (self.is_op(".", "}") or self.token.kind == "end"):
                self.property_list(subject, out)
        else:
            subject = self.term()
            self.property_list(subject, out)
        return out

    def property_list(self, subject, out: list) -> None:
        while True:
            verb = self.verb()
            while True:
                out.append((subject, verb, self.object(out)))
                if not self.op(","):
                    break
            more = False
            while self.op(";"):
                more = True
            if not more or self.is_op(".", "}", "]"):
                return

    def verb(self):
        if self.token.kind == "var":
            return self.var()
        if self.token.kind == "param":
            return self.param()
        return self.path()

    def object(self, out: list):
        if self.is_op("["):
            return self.blank_properties(out)
        if self.is_op("("):
            return self.collection(out)
        return self.term()

    def blank(self):
        return ("bnode", f".{next(self.fresh)}")

    def blank_properties(self, out: list):
        self.need("[")
        node = self.blank()
        if not self.op("]"):
            self.property_list(node, out)
            self.need("]")
        return node

    def collection(self, out: list):
        self.need("(")
        items = []
        while not self.op(")"):
            items.append(self.object(out))
        if not items:
            return ("iri", RDF + "nil")
        cells = [self.blank() for _ in items]
        for k, item in enumerate(items):
            out.append((cells[k], ("p", RDF + "first"), item))
            out.append((cells[k], ("p", RDF + "rest"), cells[k + 1] if k + 1 < len(cells) else ("iri", RDF + "nil")))
        return cells[0]

    # -- paths

    def path(self):
        p = self.path_sequence()
        while self.op("|"):
            p = ("alt", p, self.path_sequence())
        return p

    def path_sequence(self):
        p = self.path_element()
        while self.op("/"):
            p = ("seq", p, self.path_element())
        return p

    def path_element(self):
        if self.op("^"):
            return ("inv", self.path_element())
        if self.op("!"):
            return ("neg", tuple(self.negated()))
        if self.op("("):
            p = self.path()
            self.need(")")
        elif self.token.kind == "word" and self.token.text == "a":
            self.next()
            p = ("p", RDF + "type")
        else:
            p = ("p", self.iri())
        while self.is_op("?", "*", "+"):
            p = ({"?": "opt", "*": "star", "+": "plus"}[self.next().text], p)
        return p

    def negated(self) -> list:
        def one():
            inverse = self.op("^")
            if self.token.kind == "word" and self.token.text == "a":
                self.next()
                return RDF + "type", inverse
            return self.iri(), inverse

        if not self.op("("):
            return [one()]
        out = []
        while not self.op(")"):
            out.append(one())
            self.op("|")
        if not out:
            self.fail("a property")
        return out

    # -- terms

    def var(self):
        t = self.next()
        if t.kind != "var":
            self.at -= 1
            self.fail("a variable")
        return ("var", t.text[1:])

    def param(self):
        self.extension("a parameter")
        return ("param", self.next().text[1:])

    def term(self):
        t = self.token
        if t.kind == "var":
            return self.var()
        if t.kind == "param":
            return self.param()
        if self.is_iri():
            return ("iri", self.iri())
        if t.kind == "bnode":
            return ("bnode", self.next().text[2:])
        if self.is_op("["):
            self.next()
            self.need("]")
            return self.blank()
        return self.literal()

    def literal(self):
        t = self.token
        if t.kind == "string":
            self.next()
            raw = t.text[3:-3] if t.text[:3] in ('"""', "'''") and len(t.text) >= 6 else t.text[1:-1]
            text = unescape(raw)
            if self.token.kind == "lang":
                return ("lit", text, RDF + "langString", self.next().text[1:])
            if self.op("^^"):
                return ("lit", text, self.iri(), None)
            return ("lit", text, XSD + "string", None)
        sign = ""
        if self.is_op("+", "-") and self.ahead().kind in ("integer", "decimal", "double"):
            sign = self.next().text.replace("+", "")
            t = self.token
        if t.kind in ("integer", "decimal", "double"):
            self.next()
            return ("lit", sign + t.text, XSD + ("integer" if t.kind == "integer" else "double"), None)
        if t.kind == "word" and t.text.lower() in ("true", "false"):
            return ("lit", self.next().text.lower(), XSD + "boolean", None)
        if t.kind == "word" and t.text == "NULL":
            self.extension("NULL")
            self.next()
            return ("null",)
        return self.fail("a term")

    # -- expressions

    def expression(self):
        e = self.conjunction()
        while self.op("||"):
            e = ("or", e, self.conjunction())
        return e

    def conjunction(self):
        e = self.relation()
        while self.op("&&"):
            e = ("and", e, self.relation())
        return e

    def relation(self):
        e = self.sum()
        if self.is_op("=", "!=", "<", ">", "<=", ">="):
            return ("cmp", self.next().text, e, self.sum())
        if self.word("IN"):
            return ("in", e, self.arguments(), False)
        if self.is_word("NOT") and self.ahead().text.upper() == "IN":
            self.at += 2
            return ("in", e, self.arguments(), True)
        return e

    def sum(self):
        e = self.product()
        while self.is_op("+", "-"):
            e = ("arith", self.next().text, e, self.product())
        return e

    def product(self):
        e = self.unary()
        while self.is_op("*", "/"):
            e = ("arith", self.next().text, e, self.unary())
        return e

    def unary(self):
        if self.op("!"):
            return ("not", self.unary())
        if self.op("+"):
            return self.unary()
        if self.op("-"):
            return ("minus", self.unary())
        return self.primary()

    def arguments(self) -> list:
        self.need("(")
        out = []
        while not self.op(")"):
            if out:
                self.need(",")
            out.append(self.expression())
        return out

    def primary(self):
        t = self.token
        if self.is_op("("):
            if self._is_subselect():
                self.extension("a sub-query as an expression")
                self.next()
                q = self.query_body()
                self.need(")")
                return ("scalar", q)
            self.next()
            e = self.expression()
            if self.is_op(","):  # a list, for string-join
                items = [e]
                while self.op(","):
                    items.append(self.expression())
                e = ("list", items)
            self.need(")")
            return e
        if t.kind == "word":
            w = t.text.upper()
            if w in AGGREGATES:
                return self.aggregate()
            if w == "EXISTS":
                self.next()
                return ("exists", self.group(), False)
            if w == "NOT":
                self.next()
                self.need_word("EXISTS")
                return ("exists", self.group(), True)
            if w in BUILTINS:
                self.next()
                args = self.arguments()
                low, high = BUILTINS[w]
                if len(args) < low or high is not None and len(args) > high:
                    raise ParseError(f"{w} takes {low} to {high} arguments, not {len(args)}")
                return ("call", w, args)
        if self.is_iri():
            iri = self.iri()
            if self.is_op("("):
                if self.ahead().kind == "word" and self.ahead().text.upper() == "DISTINCT":
                    raise ParseError("DISTINCT is for aggregates")
                return ("call", iri, self.arguments())
            return ("term", ("iri", iri))
        if t.kind == "bnode":
            self.fail("an expression")
        return ("term", self.term())

    def aggregate(self):
        name = self.next().text.upper()
        self.need("(")
        distinct = bool(self.word("DISTINCT"))
        if name == "COUNT" and self.op("*"):
            self.need(")")
            return ("agg", name, distinct, "*", None)
        e = self.expression()
        sep = None
        if name == "GROUP_CONCAT":
            sep = ","
            if self.op(";"):
                self.need_word("SEPARATOR")
                self.need("=")
                sep = self.literal()[1]
            elif self.op(","):
                self.extension("a separator without its name")
                sep = self.literal()[1]
        self.need(")")
        return ("agg", name, distinct, e, sep)

    # -- updates

    def updates(self) -> list[Update]:
        out = []
        while True:
            self.prologue()
            if self.token.kind == "end":
                break
            u = self.update()
            u.allowed_graphs = self.allowed_graphs
            out.append(u)
            self.op(";")
        if not out:
            self.fail("an update")
        return out

    def update(self) -> Update:
        w = self.need_word("INSERT", "DELETE", "WITH", "LOAD", "CLEAR", "DROP", "CREATE", "ADD", "COPY", "MOVE")
        if w == "WITH":
            graph = self.iri()
            u = self.modify(self.need_word("INSERT", "DELETE"))
            u.with_graph = graph
            return u
        if w in ("INSERT", "DELETE"):
            return self.modify(w)
        silent = bool(self.word("SILENT"))
        if w == "LOAD":
            source = self.iri()
            target = None
            if self.word("INTO"):
                self.need_word("GRAPH")
                target = self.iri()
            return Update("load", silent, source=source, target=target)
        if w == "CREATE":
            self.need_word("GRAPH")
            return Update("create", silent, target=self.iri())
        if w in ("CLEAR", "DROP"):
            k = self.word("DEFAULT", "NAMED", "ALL")
            if not k:
                self.need_word("GRAPH")
            return Update(w.lower(), silent, target=k or self.iri())
        source = self.graph_or_default()
        self.need_word("TO")
        return Update(w.lower(), silent, source=source, target=self.graph_or_default())

    def graph_or_default(self):
        if self.word("DEFAULT"):
            return "DEFAULT"
        self.word("GRAPH")
        return self.iri()

    def modify(self, first: str) -> Update:
        silent = bool(self.word("SILENT"))
        if self.word("DATA"):
            kind = "insert_data" if first == "INSERT" else "delete_data"
            quads = self.template()
            if any(t[0] == "var" for q in quads for t in q if isinstance(t, tuple)):
                raise ParseError("variables in DATA")
            return Update(kind, silent, **{first.lower(): quads})
        u = Update("modify", silent)
        if first == "DELETE":
            if self.word("WHERE"):
                u.delete = self.template()
                u.where = _as_patterns(u.delete)
                return u
            u.delete = self.template()
            if self.word("INSERT"):
                self._insert(u)
        else:
            self._insert(u)
        while self.word("USING"):
            (u.using_named if self.word("NAMED") else u.using).append(self.iri())
        if self.word("WHERE") or self.is_op("{"):
            u.where = self.group()
        return u

    def _insert(self, u: Update) -> None:
        if self.word("OR"):
            self.extension("OR REPLACE")
            self.need_word("REPLACE")
            u.replace = True
        u.silent = bool(self.word("SILENT")) or u.silent
        if self.word("INTO"):
            self.extension("INTO")
            u.with_graph = self.iri()
        u.insert = self.template()

    def template(self) -> list:
        """Quads (s, p, o, graph) of a template; graph None is the default."""
        self.need("{")
        out = []
        while not self.op("}"):
            if self.word("GRAPH"):
                g = self.var() if self.token.kind == "var" else self.param() if self.token.kind == "param" else ("iri", self.iri())
                self.need("{")
                while not self.op("}"):
                    out += [(*t, g) for t in self.triples()]
                    self.op(".")
            else:
                out += [(*t, None) for t in self.triples()]
            self.op(".")
        return out


def _as_patterns(quads: list) -> list:
    out: list = []
    for s, p, o, g in quads:
        pattern = ("triples", [(s, p, o)])
        out.append(("graph", g, [pattern]) if g else pattern)
    return out


def _names(element: tuple) -> set[str]:
    """Variables that an element uses."""
    out: set[str] = set()

    def walk(x) -> None:
        if isinstance(x, tuple) and len(x) == 2 and x[0] == "var" and isinstance(x[1], str):
            out.add(x[1])
        elif isinstance(x, (tuple, list)):
            for y in x:
                walk(y)

    if element[0] in ("filter", "minus", "select"):
        return out
    if element[0] == "values":
        return set(element[1])
    if element[0] == "bind":
        return {element[2]}
    walk(element)
    return out
